"""Readers of landed payloads and tables, and writers."""
