"""Live capture with Structured Streaming."""
