"""Column expressions: text, numbers, dates and day counts."""
