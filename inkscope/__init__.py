"""Hidden-marker analytics on Apache Spark."""
