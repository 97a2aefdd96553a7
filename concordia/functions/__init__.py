"""Column functions: text folding, clause markers, typed values, similarity."""
