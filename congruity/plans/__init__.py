"""Harness queries and their SQL."""
