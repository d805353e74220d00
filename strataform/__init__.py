"""Spark-first analytics over semi-structured business records and their evidence."""
