"""Incremental ingest with Structured Streaming.

The analytics themselves are batch (the reference has no streaming
operators); this package only applies the same delimited-reader recipe and
dimension lookups to files as they land.
"""

from flockwatch.streaming.ingest import ingest_stream, start_ingest

__all__ = ["ingest_stream", "start_ingest"]
