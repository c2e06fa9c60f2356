"""stepweave: Spark-first operators for step-by-step manual data."""
