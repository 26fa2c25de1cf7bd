"""Column expressions and generators."""
