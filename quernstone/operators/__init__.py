"""Operators on DataFrames: ranking, text, fusion, change feeds, approximate search."""
