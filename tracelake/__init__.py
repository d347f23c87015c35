"""Trace-trigger analytics and training-data operators on Spark."""
