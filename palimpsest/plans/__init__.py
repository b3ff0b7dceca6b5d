"""Composed queries: what the command line offers."""
