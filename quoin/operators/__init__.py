"""Marketplace queries and transforms over DataFrames."""
