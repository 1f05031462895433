"""Column expressions, series windows and exact quantiles shared by all operators."""
