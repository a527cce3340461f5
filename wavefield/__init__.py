"""Batch and streaming Spark jobs that turn video of ocean waves into depth and current maps."""
