"""Bindings of operators to the driver tables: queries and their SQL."""
