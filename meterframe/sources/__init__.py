"""Readers, the event store and CSV sinks."""
