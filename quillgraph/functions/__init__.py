"""Column expressions and the few Arrow functions that have no built-in form."""
