"""Spark-first analytics for spotting brand impersonation, plus tools for training corpora."""
