"""Incremental ingest of delimited trade files (ops 1-3, 11-17, 22, 23 on a stream)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from flockwatch.operators import enrich
from flockwatch.session import ensure_checkpoint_dir
from flockwatch.sources.delimited import _split_names, split_lines


def ingest_stream(spark: SparkSession, landing_dir: str, header_line: str,
                  delimiter_regex: str = r"\|", strip_quotes: bool = False, trim: bool = False,
                  dims: dict | None = None, max_files_per_trigger: int | None = None,
                  **eligibility) -> DataFrame:
    """A streaming DataFrame of raw (all-text) or, with ``dims``, typed trades.

    ``header_line`` names the columns (a stream cannot peek at its first line);
    lines equal to it are dropped wherever they occur.  ``dims`` maps ``side``,
    ``acct``, ``trust`` and ``feed`` to static dimension DataFrames; the lookups
    are stream-static joins.
    """
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    lines = reader.load(landing_dir)
    names = _split_names(header_line, delimiter_regex, strip_quotes, trim)
    raw = split_lines(lines, names, delimiter_regex, header_line, strip_quotes, trim)
    if not dims:
        return raw
    return enrich.build_trades(raw, dims["side"], dims["acct"], dims["trust"], dims["feed"],
                               **eligibility)


def start_ingest(stream: DataFrame, output_dir: str, name: str = "trades",
                 available_now: bool = True, partition_by: list[str] | None = None) -> StreamingQuery:
    """Append the stream to a Parquet table; progress is kept in the shared
    checkpoint folder, so a restarted query resumes where it stopped."""
    base = ensure_checkpoint_dir(stream.sparkSession)
    writer = (stream.writeStream.format("parquet").outputMode("append")
                    .option("checkpointLocation", os.path.join(base, f"stream-{name}")))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start(output_dir)
