"""Readers, writers and table naming."""
