"""Tables of text and vectors on Spark: search, indexes, embedding, upkeep and control queries."""

__version__ = "0.1.0"
