"""Operators on DataFrames that the plans are put together from."""
