"""textloom: a text-memory and training-data engine on Spark DataFrames."""

__version__ = "0.1.0"
