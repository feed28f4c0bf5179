"""Registered queries: each a DataFrame over the given tables, most with SQL that says the same."""
