"""logweir: log and event analytics on Apache Spark."""
