"""Repurchase analytics as Spark DataFrame jobs."""
