"""Compositions of operators that materialise tables between steps."""
