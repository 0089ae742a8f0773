"""Message analytics on Spark: index maintenance, retrieval, usage reports, windows, text operators."""
