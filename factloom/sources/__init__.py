"""Fact tables, mappings and program texts."""
