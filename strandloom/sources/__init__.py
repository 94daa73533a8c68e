"""Readers of the domain's text files as DataFrames."""
