"""Evidlake: evidence-backed knowledge retrieval and corpus operators on Spark DataFrames."""
