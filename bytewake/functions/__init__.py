"""Column expressions: built-in functions only, so they stay inside generated code."""
