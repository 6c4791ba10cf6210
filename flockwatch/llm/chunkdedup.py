"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes; a chunk ends where the hash is the largest
within ``WIDTH`` bytes on either side.  Cuts depend on near-by bytes only, so
an insertion moves cuts around it and leaves all others where they were.  Where
equal hashes stand closer than ``WIDTH`` (a short period repeated), every one
that lies more than ``WIDTH`` past the last cut ends a chunk, so such stretches
become equal chunks; a longer piece than ``LONGEST`` is cut at the largest hash
inside.  Chunks between two cuts are thus more than ``WIDTH`` and at most
``LONGEST`` bytes; only the first and the last of a text can be shorter.  Chunks are
known by 128-bit digests; of equal chunks the one in the smallest (id, start)
is the first.  Runs of chunks that stand elsewhere first are removed when they
cover at least ``MIN_RUN`` bytes, which leaves common short phrases alone, or a
whole document.

Defined cases: null and empty texts have no chunks; repeated rows are one
document; documents without id come first; long texts are processed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flockwatch.llm.common import join_on_row_key, kept_bytes, merge_intervals, sha256_hex, text_or_empty, with_row_key
from flockwatch.session import materialize

WIDTH = 12                  # a cut is the largest hash of 2 * WIDTH + 1
LONGEST = 16 * WIDTH        # a longer piece is cut at its largest hash
MIN_RUN = 96                # bytes of repeated chunks in a row that are removed

_GEAR = np.frombuffer(b"".join(hashlib.blake2b(bytes((i,)), digest_size=8).digest() for i in range(256)), np.uint64)


def gear_hashes(body: np.ndarray) -> np.ndarray:
    """The gear hash of the last 16 bytes at every position: each older byte is shifted once more."""
    h = _GEAR[body]
    with np.errstate(over="ignore"):
        for span in (1, 2, 4, 8):
            older = np.concatenate((np.zeros(min(span, len(h)), np.uint64), h[:-span]))
            h = h + (older << np.uint64(span))
    return h


def cuts(body: np.ndarray) -> np.ndarray:
    """Chunk bounds, from 0 to the length."""
    n = len(body)
    if n <= 2 * WIDTH + 1:
        return np.array([0, n]) if n else np.array([0])
    h = gear_hashes(body)
    m, span, width = h, 1, 2 * WIDTH + 1
    while span * 2 <= width:
        m = np.maximum(m[:-span], m[span:])
        span *= 2
    m = np.maximum(m[:len(m) - (width - span)], m[width - span:])
    at = np.flatnonzero(h[WIDTH:n - WIDTH] == m) + WIDTH + 1
    if len(at) and (np.diff(at) <= WIDTH).any():        # equal hashes: the next one past WIDTH from the last cut
        following, kept, i = np.searchsorted(at, at + WIDTH, side="right").tolist(), [], 0
        while i < len(at):
            kept.append(i)
            i = following[i]
        at = at[kept]
    at = np.concatenate(([0], at, [n])).astype(np.int64)
    far = np.flatnonzero(np.diff(at) > LONGEST)
    return np.sort(np.concatenate((at, *(_inside(h, *at[i:i + 2].tolist()) for i in far)))) if len(far) else at


def _inside(h: np.ndarray, start: int, end: int) -> np.ndarray:
    """Cuts at the largest hash more than ``WIDTH`` from both ends, again and again until no piece is too long."""
    out, open_ = [], [(start, end)]
    while open_:
        a, b = open_.pop()
        if b - a > LONGEST:
            c = a + WIDTH + 1 + int(h[a + WIDTH:b - WIDTH - 1].argmax())
            out.append(c)
            open_ += [(a, c), (c, b)]
    return np.array(out, np.int64)


def _chunk_rows(docs: DataFrame, id_col: str) -> DataFrame:
    """(d1, d2, id, _th, start, size) of every chunk."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["d1", "d2", id_col, "_th", "start", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, digests, starts, sizes = [], [], [], []

            def flush(b=b):
                d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                take = pa.array(np.concatenate(rows))
                return pa.RecordBatch.from_arrays(
                    [pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), b.column(0).take(take), b.column(1).take(take),
                     pa.array(np.concatenate(starts)), pa.array(np.concatenate(sizes))], names)

            for i, v in enumerate(b.column(2).cast(pa.large_binary())):
                text = v.as_py()
                at = cuts(np.frombuffer(text, np.uint8))
                ends = at.tolist()
                digests += [hashlib.blake2b(text[s:e], digest_size=16).digest() for s, e in zip(ends[:-1], ends[1:], strict=True)]
                rows.append(np.full(len(at) - 1, i))
                starts.append(at[:-1])
                sizes.append(np.diff(at))
                if len(digests) > 50_000:
                    yield flush()
                    rows, digests, starts, sizes = [], [], [], []
            if digests:
                yield flush()

    return docs.select(id_col, "_th", "_t").mapInArrow(
        run, f"d1 long, d2 long, `{id_col}` {kind}, _th long, start long, size long")


def removed_runs(starts: np.ndarray, sizes: np.ndarray, min_run: int = MIN_RUN, n: int | None = None) -> list[tuple[int, int]]:
    """Runs of at least ``min_run`` bytes, and one that covers a whole text of ``n`` bytes whatever its length."""
    a, b = merge_intervals(starts, starts + sizes)
    long = (b - a >= min_run) | ((b - a == n) if n else False)
    return list(zip(a[long].tolist(), b[long].tolist(), strict=True))


def remove_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = MIN_RUN) -> DataFrame:
    """One row per document: id, n_bytes, n_chunks, n_repeated, spans (removed byte ranges), kept_sha256."""
    docs = with_row_key(docs, id_col, text_col).select(id_col, "_th", text_or_empty(text_col).alias("_t"))
    kind = docs.schema[id_col].dataType.simpleString()
    # The first pass sends digests and partial counts only: a chunk found everywhere is one row per map task.
    # Places are sent for repeated digests alone.
    repeated = materialize(_chunk_rows(docs, id_col).groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("k"))
                           .where(F.col("k") > 1).select("d1", "d2"), "chunk-repeated")
    places = materialize(_chunk_rows(docs, id_col).join(repeated, ["d1", "d2"]), "chunk-places")
    firsts = places.groupBy("d1", "d2").agg(F.min(F.struct(id_col, "_th", "start")).alias("first"))
    later = (places.join(firsts, ["d1", "d2"])
             .where(~F.struct(id_col, "_th", "start").eqNullSafe(F.col("first")))
             .groupBy(id_col, "_th").agg(F.collect_set(F.struct("start", "size")).alias("later")))
    joined = join_on_row_key(docs, later, id_col)
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for v, later in zip(b.column(1).cast(pa.large_binary()), b.column(2).to_pylist(), strict=True):
                text = v.as_py()
                starts = np.array([x["start"] for x in later or []], np.int64)
                sizes = np.array([x["size"] for x in later or []], np.int64)
                spans = removed_runs(starts, sizes, min_run, len(text))
                out.append((len(text), len(cuts(np.frombuffer(text, np.uint8))) - 1, len(starts),
                            [{"start": s, "end": e} for s, e in spans], sha256_hex(kept_bytes(text, spans))))
            n, chunks, repeated, spans, sha = zip(*out, strict=True) if out else ([],) * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(chunks, pa.int64()), pa.array(repeated, pa.int64()),
                 pa.array(spans, spans_type), pa.array(sha, pa.string())],
                [id_col, "n_bytes", "n_chunks", "n_repeated", "spans", "kept_sha256"])

    return joined.select(id_col, "_t", "later").mapInArrow(
        finish, f"`{id_col}` {kind}, n_bytes long, n_chunks long, n_repeated long, "
                "spans array<struct<start:long,end:long>>, kept_sha256 string")
