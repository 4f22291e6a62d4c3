"""Relational and signal operators over the tables the sources yield."""
