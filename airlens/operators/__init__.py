"""Operators: DataFrame in, DataFrame out; one module per family."""
