"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space in the contracts: U+0020 and U+0009 to U+000D.  Fixed values.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, UPPER, UPPER.lower())


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def with_row_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add ``_th``, a hash of the text: (id, ``_th``) identifies a row up to exact repeats.

    Repeated rows share the key, and every per-row result here depends on the
    id and the text alone, so repeats get the same result.
    """
    return docs.withColumn("_th", F.xxhash64(text_or_empty(text_col)))


def join_on_row_key(left: DataFrame, right: DataFrame, id_col: str = "doc_id", how: str = "left") -> DataFrame:
    """Join per-row results back (null ids match null ids); the right side's key columns go."""
    r = right.withColumnRenamed(id_col, "_rid").withColumnRenamed("_th", "_rth")
    cond = left[id_col].eqNullSafe(r["_rid"]) & (left["_th"] == r["_rth"])
    out = left.join(r, cond, how)
    return out.drop("_rid", "_rth") if how not in ("left_anti", "left_semi") else out


def utf8_column(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty texts."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    _, offs, data = col.buffers()
    n = len(col)
    offsets = np.frombuffer(offs, dtype=np.int64, count=col.offset + n + 1)[col.offset:]
    body = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text_at: int, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into row runs of about ``max_bytes`` of text (one row at least)."""
    body, offsets = utf8_column(batch.column(text_at))
    del body
    start, n = 0, batch.num_rows
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + max_bytes, side="right")) - 1
        stop = min(max(stop, start + 1), n)
        yield batch.slice(start, stop - start)
        start = stop


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the sorted, disjoint ``spans``."""
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    out.append(text[at:])
    return b"".join(out)


def merge_intervals(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals as sorted, maximal runs (touching runs join)."""
    if len(starts) == 0:
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    first = np.concatenate(([True], s[1:] > e[:-1]))
    last = np.concatenate((first[1:], [True]))
    return s[first], e[last]


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
