"""Column functions: analysis, numeric encodings, similarity."""
