"""Structured Streaming: sources, fan-out, monitoring, bounded buffers and run control."""
