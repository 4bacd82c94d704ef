"""Compositions of operators: cleaning, rating, reports, a file end to end."""
