"""Dialect-faithful analytics, table repair and result scoring as Spark jobs."""
