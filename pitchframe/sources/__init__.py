"""Readers, writers and parsers of landed payloads."""
