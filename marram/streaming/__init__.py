"""Streaming forms of the map and of time association."""
