"""Column expressions and small DataFrame helpers."""
