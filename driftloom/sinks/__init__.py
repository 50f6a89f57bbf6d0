"""Sinks: files, console and Kafka."""
