"""A Spark-first engine for procurement evidence and analytics."""
