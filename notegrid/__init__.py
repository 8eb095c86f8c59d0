"""Typed-wiki analytics on Spark DataFrames."""
