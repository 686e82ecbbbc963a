"""Table pipelines, expressions, typed objects, relations and sequence analytics on Spark."""
