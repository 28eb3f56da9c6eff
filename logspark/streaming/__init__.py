"""Structured Streaming: ingest, windowed counts, detection and silencing."""
