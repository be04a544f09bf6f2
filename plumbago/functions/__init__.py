"""Column expressions: text, rewriting, chunking, tokens, vectors."""
