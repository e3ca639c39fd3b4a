"""Readers. Each returns a DataFrame; none collects."""
