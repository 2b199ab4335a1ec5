"""Operators: DataFrame in, DataFrame out, keyed by user; none runs an action."""
