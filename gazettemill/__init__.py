"""Media-coverage analytics and corpus preparation as Spark jobs."""
