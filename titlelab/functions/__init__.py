"""Column functions: text cleaning, parsing, hashing, arrays."""
