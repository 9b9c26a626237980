"""Column functions: addresses and URLs."""
