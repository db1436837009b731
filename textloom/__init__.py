"""textloom: full-text retrieval and link analysis on Spark DataFrames."""

__version__ = "0.1.0"
