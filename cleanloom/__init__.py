"""A Spark-first data cleaning engine."""
