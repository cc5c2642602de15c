"""Registered queries: operators wired to the test tables, next to their SQL twins."""
