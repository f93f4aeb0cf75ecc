"""gridspark: gridded fields, column diagnostics and runtime-experiment analysis on Spark DataFrames."""

__version__ = "0.1.0"
