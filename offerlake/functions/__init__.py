"""Column builders: each takes columns and returns a column of built-in expressions."""
