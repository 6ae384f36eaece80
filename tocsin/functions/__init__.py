"""Column expressions: text, keys, vectors, romanisation."""
