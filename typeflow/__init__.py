"""Typed data conversion and tool-pipeline analytics on Spark DataFrames."""
