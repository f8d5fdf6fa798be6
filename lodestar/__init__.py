"""Retrieval and ranking analytics expressed as Spark DataFrame transforms."""
