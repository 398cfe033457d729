"""Hybrid catalogue retrieval and corpus preparation as Spark jobs."""
