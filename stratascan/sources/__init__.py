"""Scans, footer tables, file checks and sinks."""
