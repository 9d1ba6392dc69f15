"""Column expressions, fixed value lists and small statistics helpers."""
