"""Compositions of operators: the search pipeline, the index, the query catalogue."""
