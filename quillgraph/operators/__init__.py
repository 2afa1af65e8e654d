"""Relational operators: one function per operator, DataFrame in, DataFrame out."""
