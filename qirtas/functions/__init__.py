"""Column expressions: text, values, timestamps."""
