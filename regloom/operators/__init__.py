"""Operators: DataFrame or Columns in, DataFrame or Columns out."""
