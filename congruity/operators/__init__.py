"""Reconciliation levels, each a function from DataFrames to DataFrames."""
