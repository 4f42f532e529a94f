"""Column expressions: nulls, time, text, numbers, places."""
