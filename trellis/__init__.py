"""Trellis: semantic property-graph analytics expressed as plain Spark DataFrames."""
