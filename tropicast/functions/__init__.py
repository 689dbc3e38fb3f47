"""Column expressions and small grouped helpers shared by the operators."""
