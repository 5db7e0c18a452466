"""titlelake: short-title dataset curation and evaluation on Spark DataFrames."""

__version__ = "0.1.0"
