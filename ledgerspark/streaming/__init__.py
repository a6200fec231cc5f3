"""Structured Streaming: continuous import of journal file drops."""

from .ingest import stream_import

__all__ = ["stream_import"]
