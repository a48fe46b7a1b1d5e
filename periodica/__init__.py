"""Period-based analytics on event tables, written as Spark DataFrame code."""
