"""Column functions and the distributed ranking helper."""
