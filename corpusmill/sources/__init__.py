"""Scans and sinks: table reads, file sources and shared intermediate tables."""
