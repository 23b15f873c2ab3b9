"""Column expressions and name lists."""
