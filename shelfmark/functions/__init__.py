"""Column expressions: text, JSON, vectors and timestamps."""
