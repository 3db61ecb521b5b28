"""Live analysis with Structured Streaming."""
