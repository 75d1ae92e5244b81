"""Column helpers: text rules, vectors, metrics."""
