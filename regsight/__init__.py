"""regsight: reporting over regulatory submission data, built on Spark DataFrames."""

__version__ = "0.1.0"
