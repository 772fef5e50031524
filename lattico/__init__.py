"""Spark-first analytics over typed-decision records."""
