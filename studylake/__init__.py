"""Notes, study-log and planning analytics as Spark jobs."""
