"""Column expressions: grids, quantities, captions, tokens, vectors."""
