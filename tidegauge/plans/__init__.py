"""Studies composed from the operators."""
