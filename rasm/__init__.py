"""Transcript and corpus analytics on Spark DataFrames."""
