"""Domains, literals and scalar functions."""
