"""Vector similarity search and corpus preparation as Spark DataFrame jobs."""
