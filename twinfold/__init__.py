"""twinfold: duplicate analytics over files and tables, expressed as Spark DataFrames."""

__version__ = "0.1.0"
