"""Skeinwork: document retrieval and algorithm analytics, written for Spark's DataFrame and SQL API."""
