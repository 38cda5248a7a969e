"""Corpus preparation, retrieval and usage analytics on Spark."""
