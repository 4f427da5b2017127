"""Column-in, Column-out building blocks."""
