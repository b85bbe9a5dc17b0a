"""Repeated scans: a fixed-delay loop, and a Structured Streaming front end."""
