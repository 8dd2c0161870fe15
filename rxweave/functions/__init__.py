"""Column functions: text cleaning, severity rules, similarity, vectors."""
