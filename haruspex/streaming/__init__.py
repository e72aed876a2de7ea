"""Structured Streaming twins of mergeable operators."""
