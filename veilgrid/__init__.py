"""Anonymized synthetic tables on Spark."""
