"""Transcript and edit-decision analytics on Spark DataFrames."""
