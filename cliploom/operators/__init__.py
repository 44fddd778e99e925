"""Operators over domain frames: each takes DataFrames and returns DataFrames or columns."""
