"""Readers that turn files, documents and other programs' lists into DataFrames."""
