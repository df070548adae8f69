"""Point-in-time research analytics as Spark jobs."""
