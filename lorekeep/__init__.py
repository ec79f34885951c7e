"""Document retrieval analytics on Spark."""
