"""Structured Streaming: incremental ingest and the windowed monitor."""
