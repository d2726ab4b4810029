"""lexloom operators."""
