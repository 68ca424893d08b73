"""Run events as Structured Streaming queries."""
