"""Joins, merges and orderings."""
