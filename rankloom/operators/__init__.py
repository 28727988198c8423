"""Operators: index build, matching and ranking, spelling, dense retrieval, and learning-to-rank data."""
