"""Structured Streaming: run liveness and windowed counts."""
