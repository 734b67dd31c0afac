"""Quillmill: corpus curation, review and retrieval jobs on Spark DataFrames."""
