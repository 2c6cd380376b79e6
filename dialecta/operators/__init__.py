"""TODO."""
