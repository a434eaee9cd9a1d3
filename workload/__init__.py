"""Queries over the given tables, with the same queries in DuckDB SQL to check them."""
