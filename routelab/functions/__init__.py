"""Column expressions: text parsing, similarity, vectors, keys and money."""
