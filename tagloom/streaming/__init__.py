"""Structured Streaming: event-time windows, resumable manifest jobs, sliding contexts."""
