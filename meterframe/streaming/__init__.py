"""Structured Streaming wiring: ingest, windows and incremental state."""
