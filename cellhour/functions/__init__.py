"""Column expressions and order statistics the operators are built from."""
