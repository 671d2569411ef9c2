"""Corvane: retrieval analytics as Spark DataFrame plans."""
