"""Operators: DataFrames in, a lazy DataFrame out, every order total."""
