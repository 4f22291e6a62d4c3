"""Bindings of the engine to the given tables: inputs, queries and the SQL each is checked against."""
