"""Column expressions: bytes and tokens, quantised blocks, ordered float reductions, digests, headers."""
