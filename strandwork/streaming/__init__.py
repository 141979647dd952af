"""Structured Streaming: windows, de-duplication, sessions and keyed state."""
