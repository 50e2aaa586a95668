"""Clauses and their analysis before anything runs."""
