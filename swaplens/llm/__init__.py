"""Operators for training-data pipelines over model traffic; nothing outside this package imports it."""
