"""Relational operators: each is DataFrame(s) -> DataFrame, no driver collect."""
