"""Queries over the sample tables and the SQL that checks them."""
