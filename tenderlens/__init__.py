"""Procurement-risk analytics on Spark DataFrames."""
