"""Loreforge: document-to-knowledge operators on Spark DataFrames."""
