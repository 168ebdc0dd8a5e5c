"""Column expressions: geometry, text and dates."""
