"""Tests of topicspark.llm."""
