"""Training and recognition plans built from the operators."""
