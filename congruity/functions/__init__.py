"""Column builders shared by the levels."""
