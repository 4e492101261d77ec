"""Public-spending analytics as Spark jobs."""
