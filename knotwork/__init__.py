"""Sparse and graph analytics over coordinate DataFrames (i, j, v)."""
