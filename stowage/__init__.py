"""Storage analytics on PySpark: files, chunks, installs, jobs and texts as DataFrames."""

__version__ = "0.1.0"
