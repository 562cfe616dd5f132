"""Column expressions: hashing, text and arrays."""
