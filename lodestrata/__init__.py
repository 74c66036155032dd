"""Spark-first metadata discovery, capability search and corpus analytics."""
