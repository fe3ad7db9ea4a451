"""Column expressions and distributed ordering helpers."""
