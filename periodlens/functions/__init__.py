"""Column expressions: text, lists, labels and statistics."""
