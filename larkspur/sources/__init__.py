"""Stored tables, their catalog, and the XML source and sink."""
