"""Readers of exported API responses and label trees, and the parquet state tables."""
