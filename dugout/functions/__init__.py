"""Column expressions: each takes columns (or names) and returns a column."""
