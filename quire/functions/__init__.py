"""Column functions: text, paths and names."""
