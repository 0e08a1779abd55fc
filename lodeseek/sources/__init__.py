"""Scans, gates and sinks."""
