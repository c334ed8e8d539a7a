"""Structured Streaming entry points."""

from .ingest import start_silver_sink, stream_catalog

__all__ = ["start_silver_sink", "stream_catalog"]
