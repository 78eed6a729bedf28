"""Structured Streaming: painting images with a fitted plan as they arrive."""
