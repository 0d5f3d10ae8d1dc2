"""Column expressions: randomness, shapes, numbers, dates, keys and providers."""
