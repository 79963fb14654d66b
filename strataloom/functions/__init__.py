"""Column-to-column helpers used by the operators."""
