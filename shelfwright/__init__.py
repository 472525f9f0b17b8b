"""Catalogue analytics and large-scale data preparation on Spark DataFrames."""

__version__ = "0.1.0"
