"""Topology-aware clustering analytics on Spark DataFrames."""
