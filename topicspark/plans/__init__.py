"""Flows of several Spark jobs: training and inference."""
