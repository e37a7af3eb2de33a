"""Column expressions: text, time, media and number formatting."""
