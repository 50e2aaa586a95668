"""Operators that prepare text corpora for training; see queries.py for how each is registered."""
