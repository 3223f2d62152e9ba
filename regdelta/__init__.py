"""Document change intelligence and corpus preparation as Spark jobs."""
