"""Congruity: declarative reconciliation of two datasets on Spark DataFrames."""
