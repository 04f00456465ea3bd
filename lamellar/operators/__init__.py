"""Relational, numeric and binary operators."""
