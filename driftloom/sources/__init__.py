"""Scans: landed payloads, history ranges and custom sources."""
