"""Column functions with the missing-value rules of the panel."""
