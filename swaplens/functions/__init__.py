"""Scalar functions: Column expressions, and plain Python twins where Spark has no built-in."""
