"""The per-row operators over Structured Streaming sources."""
