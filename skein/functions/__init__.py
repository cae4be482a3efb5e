"""Column functions: built-in expressions unless a docstring says otherwise."""
