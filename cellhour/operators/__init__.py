"""Operators: DataFrame in, DataFrame out; only fitted parameters reach the driver."""
