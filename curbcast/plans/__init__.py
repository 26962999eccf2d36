"""Composed jobs, derived tables and the query registry."""
