"""Column helpers (geometry, scalar semantics, text) and their SQL names."""
