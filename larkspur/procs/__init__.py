"""Stored procedures: a small typed language with query-driven loops."""
