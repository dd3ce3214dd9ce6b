"""Training-data operators: one module each, all built from Spark jobs."""
