"""Queries over the given tables, each beside the SQL that states its expected result."""
