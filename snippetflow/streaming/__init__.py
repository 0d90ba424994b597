"""The per-row stages on Structured Streaming sources."""
