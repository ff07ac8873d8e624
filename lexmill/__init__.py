"""lexmill: a Spark-first document-intelligence and retrieval engine."""
