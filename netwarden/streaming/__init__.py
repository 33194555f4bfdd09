"""Structured Streaming detectors and sinks."""
