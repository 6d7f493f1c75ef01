"""Lodestone: knowledge retrieval and graph analytics on Spark DataFrames."""
