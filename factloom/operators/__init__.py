"""Rule evaluation and browsing, as DataFrame operations."""
