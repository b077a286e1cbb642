"""Road-traffic analytics as Spark DataFrame, SQL, ML and Structured Streaming jobs."""
