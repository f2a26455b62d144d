"""Period trends, lexicon counts, label roll-ups, change points and era clustering on Spark DataFrames."""

__version__ = "0.1.0"
