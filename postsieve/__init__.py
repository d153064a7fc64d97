"""Posting screening, funnel analytics and corpus preparation as Spark jobs."""
