"""rankloom: full-text and dense retrieval, and learning-to-rank data, as Spark DataFrames."""

__version__ = "0.1.0"
