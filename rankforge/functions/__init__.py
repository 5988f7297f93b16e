"""Column expressions: text analysis and position lists."""
