"""Column functions: text, arrays, vectors."""
