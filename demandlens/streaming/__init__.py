"""Streams of pipeline events, as Structured Streaming queries."""
