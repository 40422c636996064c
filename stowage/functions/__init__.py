"""Column expressions and Arrow functions that the operators share."""
