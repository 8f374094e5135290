"""Column expressions: JSON decoding, text tests, value types, event fields."""
