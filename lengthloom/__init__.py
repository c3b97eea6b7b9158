"""Batch analytics on dimension data, written as Spark DataFrame and SQL operators."""
