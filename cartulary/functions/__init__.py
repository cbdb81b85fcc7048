"""Column expressions. Nothing here calls Python per row."""
