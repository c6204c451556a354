"""Sequence and structure analytics on Spark."""
