"""Column expressions: text, patterns, dates, vectors and grid directions."""
