"""Column functions: text, addresses, names."""
