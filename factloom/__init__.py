"""Recursive fact analytics and corpus preparation on PySpark."""
