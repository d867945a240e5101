"""Incremental state and event-time windows."""
