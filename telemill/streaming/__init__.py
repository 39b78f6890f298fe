"""Live variants of the operators on Structured Streaming."""
