"""Quern: document-context analytics and corpus preparation on Spark DataFrames."""
