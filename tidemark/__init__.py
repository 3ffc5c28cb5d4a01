"""Spark analytics for a data platform's own estate."""
