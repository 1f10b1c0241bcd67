"""Column expressions: text, money, dates and deterministic draws."""
