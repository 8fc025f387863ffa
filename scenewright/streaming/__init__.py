"""Structured Streaming jobs over growing logs and arriving scenes."""
