"""Column functions: dates, texts, numbers and rules."""
