"""Analytics over offline web archives and large text corpora, on Spark DataFrames."""

__version__ = "0.1.0"
