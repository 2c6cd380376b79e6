"""Queries written in the source dialects, planned by the front end."""
