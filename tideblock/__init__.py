"""Market microstructure analytics as keyed Spark DataFrame and Structured Streaming jobs."""
