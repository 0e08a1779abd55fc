"""Relational and ranking operators; each takes and returns DataFrames."""
