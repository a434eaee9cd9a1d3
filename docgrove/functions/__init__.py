"""Column expressions: text rules and label paths."""
