"""Readers and the source registry."""
