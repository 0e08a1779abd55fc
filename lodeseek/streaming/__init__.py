"""Structured Streaming: the watch mode."""
