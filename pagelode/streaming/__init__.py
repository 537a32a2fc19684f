"""Structured Streaming: new questions against prepared tables."""
