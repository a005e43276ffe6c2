"""Tidemark: analytics and search over event logs and conversations, on Spark's DataFrame and SQL API."""
