"""twinscript: parallel-corpus operators on Spark DataFrames."""

__version__ = "0.1.0"
