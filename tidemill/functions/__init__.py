"""Column expressions that queries share."""
