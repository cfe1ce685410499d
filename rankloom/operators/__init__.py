"""Operators: DataFrame to DataFrame, no actions inside unless said."""
