"""Column functions: exact money, rounding, narration tokens, text similarity, digests."""
