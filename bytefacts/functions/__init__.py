"""Column expressions: instruction words, scalars and identifiers."""
