"""Spark-first analytics for media catalogues, listening history and training corpora."""
