"""Column functions: lookups, text, vectors, measures."""
