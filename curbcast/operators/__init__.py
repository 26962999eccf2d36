"""Relational operators: features, kernels, scoring, ranking, selection."""
