"""Spark-first analytics over document, conversation, event and graph tables."""
