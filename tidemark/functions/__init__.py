"""Column functions: exact arithmetic, spans, labels, comments."""
