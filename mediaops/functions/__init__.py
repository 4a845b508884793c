"""Column expressions and fixed rule tables used by the operators."""
