"""Retrieval analytics on Spark: declarative DataFrame operators over documents, vectors and run logs."""
