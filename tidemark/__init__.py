"""Tidemark: equity-research and corpus analytics as Spark DataFrame operators."""
