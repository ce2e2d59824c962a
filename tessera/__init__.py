"""URL-threat analytics and corpus preparation expressed as Spark jobs."""
