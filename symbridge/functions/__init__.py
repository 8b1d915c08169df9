"""Column functions: scalars and similarities."""
