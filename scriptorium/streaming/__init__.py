"""Structured Streaming forms: windows over events, and the last writer of every cell as state."""
