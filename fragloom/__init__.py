"""Restriction-map analytics on Spark."""
