"""Batch analytics over labelled event traces, written as Spark jobs."""
