"""Exact removal of repeated byte strings by two-stage suffix sorting.

A byte goes when a string of ``LENGTH`` bytes that covers it starts anywhere
else too.  Sorting all suffixes of a corpus would shuffle every suffix with
its next 200 bytes.  Instead, suffixes are sorted only where repeats can be,
and equal strings still always meet:

* Every window of ``LENGTH`` bytes names an anchor, its leftmost least
  ``GRAM``-byte gram by hash.  Equal windows have equal anchors at equal
  offsets.  There is about one anchor per 80 bytes.
* Anchors whose gram occurs once are done.  Anchors whose whole context (all
  windows that can name them) occurs again are repeats throughout.
* What remains are the edges of repeats: contexts that differ although their
  anchors agree.  They are gathered by anchor, and each batch of groups is
  suffix-sorted: suffixes smaller than their successors are sorted directly,
  the others are induced by a scan over first-byte buckets.  Common prefixes
  of neighbours then show the repeated windows.

A group too large for one batch is halved by intervals of window offsets, which
lengthens the bytes its members must share, until it fits or is one window.

Defined cases: null and empty texts have no bytes and lose none; texts shorter
than ``LENGTH`` are kept; repeated rows are occurrences of their own, so each
of them loses what repeats; long texts are processed in overlapping pieces.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flockwatch.llm.common import join_on_row_key, kept_bytes, merge_intervals, sha256_hex, text_or_empty, with_row_key
from flockwatch.session import materialize

LENGTH = 200                # repeated strings of so many bytes go
GRAM = 48                   # bytes of an anchor: 32 + 16
REACH = LENGTH - GRAM       # a window names one of its first REACH + 1 grams
PIECE = 1 << 20             # window starts per piece of a long text
BATCH_BYTES = 1 << 20       # context bytes sorted at once
HOT_CONTEXTS = BATCH_BYTES // (REACH + LENGTH)
OFFSETS = 256               # window offsets before an anchor, a power of two above REACH

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _scramble(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * _M1
        x = (x ^ (x >> np.uint64(33))) * _M2
        return x ^ (x >> np.uint64(33))


_BYTES = [_scramble(np.arange(256, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15 * i & (2**64 - 1))) for i in (1, 2)]
_BASE = 0x5851F42D4C957F2D
_FACTOR = {span: np.uint64(pow(0x9E3779B97F4A7C15, span, 1 << 64)) for span in (1, 2, 4, 8, 16)}


def gram_hashes(body: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from every position, by doubling to 32 and adding 16."""
    h, spans = _BYTES[0][body], {}
    with np.errstate(over="ignore"):
        for span in (1, 2, 4, 8, 16):
            spans[span] = h
            h = h[:-span] * _FACTOR[span] + h[span:]
        return _scramble(h[:len(body) - GRAM + 1] * _FACTOR[16] + spans[16][32:])


def window_minima(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    span = 1
    while span * 2 <= width:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    rest = width - span
    return np.minimum(v[:len(v) - rest], v[rest:]) if rest else v


def anchors(body: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, gram hash, first, last) of the anchors: of each window of LENGTH bytes, its leftmost least gram.

    ``first`` and ``last`` are the starts of the windows that name the anchor.
    """
    if len(body) < LENGTH:
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, np.uint64), none, none
    low = np.uint64((1 << 24) - 1)
    found = []
    for start in range(0, len(body) - LENGTH + 1, PIECE):
        h = gram_hashes(body[start:start + PIECE + LENGTH - 1])
        packed = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        least = window_minima(packed, REACH + 1)
        first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        last = np.append(first[1:] - 1, len(least) - 1)
        at = (least[first] & low).astype(np.int64)
        found.append((at + start, h[at], first + start, last + start))
    p, h, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
    keep = np.concatenate(([True], p[1:] > p[:-1]))         # an anchor may be named on both sides of a cut
    last = np.append(last[np.flatnonzero(keep)[1:] - 1], last[-1])
    return p[keep], h[keep], first[keep], last


class _Powers:
    """Powers of the base and of its inverse, grown when a longer text comes."""

    up = down = np.zeros(0, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 16)
            with np.errstate(over="ignore"):
                cls.up = np.multiply.accumulate(np.full(size, _BASE, np.uint64))
                cls.down = np.multiply.accumulate(np.full(size, pow(_BASE, -1, 1 << 64), np.uint64))
        return cls.up[:n], cls.down[:n]


def context_hashes(body: np.ndarray, at: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the anchors' contexts, the bytes of all windows that name them."""
    up, down = _Powers.of(len(body) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[1][body] * up[:-1], dtype=np.uint64)))
        shape = ((at - start) * (LENGTH + 1) + (end - at)).astype(np.uint64)
        return _scramble((sums[end] - sums[start]) * down[start] + _scramble(shape))


def place(at, start, end):
    """Position, bytes before and bytes behind of a context in one number."""
    return (at << 16) | ((at - start) << 8) | (end - at)


def unplace(p):
    """(position, start, end) of a context."""
    at = p >> 16
    return at, at - ((p >> 8) & 255), at + (p & 255)


# ---------------------------------------------------------------------------
# Two-stage suffix sorting
# ---------------------------------------------------------------------------

def _words(t: np.ndarray) -> np.ndarray:
    """The eight bytes from every position as one big-endian number (zeros past the end)."""
    k = np.concatenate((t, np.zeros(8, np.uint8))).astype(np.uint64)
    for span in (1, 2, 4):
        k = (k[:-span] << np.uint64(8 * span)) | k[span:]
    return k[:len(t)]


def smaller_than_successor(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the one after it (the empty suffix is smallest)."""
    n = len(t)
    differ = np.append(t[:-1] != t[1:], True)
    turn = np.where(differ, np.arange(n), n)
    turn = np.minimum.accumulate(turn[::-1])[::-1]          # the next place where bytes change
    return np.append(t[:-1] < t[1:], False)[turn]


def _sort_directly(at: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes ``at`` by their first ``depth`` bytes: ties are sorted on by the next eight."""
    n = len(words)
    order = np.argsort(words[at], kind="stable")
    at = at[order]
    rank = np.cumsum(np.concatenate(([0], words[at][1:] != words[at][:-1])))
    for skip in range(8, depth, 8):
        tied = np.concatenate(([False], rank[1:] == rank[:-1]))
        tied[:-1] |= tied[1:]
        where = np.flatnonzero(tied)
        if len(where) == 0:
            break
        sub = at[where]
        more = np.where(sub + skip < n, words[np.minimum(sub + skip, n - 1)], np.uint64(0))
        order = np.lexsort((more, rank[where]))
        at[where], more = sub[order], more[order]
        old = rank[where]
        new = np.concatenate(([False], (old[1:] == old[:-1]) & (more[1:] != more[:-1])))
        step = np.zeros(len(at), np.int64)
        step[where] = new
        rank = rank + np.cumsum(step)
    return at


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` bytes, by two-stage sorting."""
    n, small = len(t), smaller_than_successor(t)
    direct = _sort_directly(np.flatnonzero(small), _words(t), depth)
    ends = np.searchsorted(t[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[t[n - 1]].append(np.array([n - 1]))             # before the empty suffix, and larger

    def induce(scanned: np.ndarray, byte: int) -> np.ndarray:
        """Put the larger predecessors into their buckets; those of this bucket are returned."""
        before = scanned[scanned > 0] - 1
        before = before[~small[before]]
        first = t[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        again = before[:0]
        cuts = [0, *(np.flatnonzero(first[1:] != first[:-1]) + 1), len(first)] if len(first) else []
        for a, b in itertools.pairwise(cuts):
            if first[a] == byte:
                again = before[a:b]
            else:
                waiting[first[a]].append(before[a:b])
        return again

    out = []
    for byte in range(256):
        wave = np.concatenate(waiting[byte]) if waiting[byte] else direct[:0]
        while len(wave):
            out.append(wave)
            wave = induce(wave, byte)
        part = direct[ends[byte]:ends[byte + 1]]
        if len(part):
            out.append(part)
            induce(part, byte)
    return np.concatenate(out)


def shares_prefix(t: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For neighbours in ``order``: is their common prefix at least ``length`` bytes?"""
    words = _words(t)
    a, b = order[:-1], order[1:]
    alive = np.flatnonzero(np.maximum(a, b) + length <= len(t))
    for skip in [*range(0, length - 7, 8), length - 8]:
        alive = alive[words[a[alive] + skip] == words[b[alive] + skip]]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def repeated_windows(texts: list[bytes], origin: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """Per text, the starts of its LENGTH-byte windows that also start elsewhere in the batch.

    Text i is the bytes of document ``origin[i]`` from ``place[i]`` on; the same
    window of the same document in two overlapping texts is not a repeat.
    """
    sizes = np.array([len(x) for x in texts])
    t = np.frombuffer(b"".join(texts), np.uint8)
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    owner = np.repeat(np.arange(len(texts)), sizes)
    inside = np.arange(len(t)) - first[owner]
    whole = inside + LENGTH <= sizes[owner]
    order = suffix_array(t, LENGTH)
    order = order[whole[order]]
    if len(order) < 2:
        return [np.zeros(0, np.int64) for _ in texts]
    same = shares_prefix(t, order, LENGTH)
    who, where = origin[owner[order]], place[owner[order]] + inside[order]
    other = same & ((who[1:] != who[:-1]) | (where[1:] != where[:-1]))
    hit = np.zeros(len(order), bool)
    hit[1:] |= other
    hit[:-1] |= other
    at = np.sort(order[hit])
    return np.split(inside[at], np.searchsorted(at, first[1:]))


# ---------------------------------------------------------------------------
# Spark
# ---------------------------------------------------------------------------

def _anchor_rows(docs: DataFrame, id_col: str) -> DataFrame:
    """(f, c, id, _th, p): gram hash, context hash and place of every anchor."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, fs, cs, ps, held = [], [], [], [], 0
            for i, v in enumerate(b.column(2).cast(pa.large_binary())):
                body = np.frombuffer(v.as_buffer() or b"", np.uint8)
                p, h, first, last = anchors(body)
                if len(p):
                    rows.append(np.full(len(p), i))
                    fs.append(h)
                    cs.append(context_hashes(body, p, first, last + LENGTH))
                    ps.append(place(p, first, last + LENGTH))
                    held += len(p)
                if held > 100_000 or held and i == b.num_rows - 1:
                    take = pa.array(np.concatenate(rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(fs).view(np.int64)), pa.array(np.concatenate(cs).view(np.int64)),
                         b.column(0).take(take), b.column(1).take(take), pa.array(np.concatenate(ps))],
                        ["f", "c", id_col, "_th", "p"])
                    rows, fs, cs, ps, held = [], [], [], [], 0
            if held:
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(fs).view(np.int64)), pa.array(np.concatenate(cs).view(np.int64)),
                     b.column(0).take(take), b.column(1).take(take), pa.array(np.concatenate(ps))],
                    ["f", "c", id_col, "_th", "p"])

    return docs.select(id_col, "_th", "_t").mapInArrow(run, f"f long, c long, `{id_col}` {kind}, _th long, p long")


def _edge_contexts(marked: DataFrame, id_col: str) -> DataFrame:
    """(key, id, _th, place, body, anchor, lo, hi, iv, span) of the anchors listed in ``edges`` (f, p).

    Windows start lo..hi bytes before the anchor; iv and span are the interval of
    offsets that the key stands for.
    """
    kind = marked.schema[id_col].dataType.simpleString()
    names = ["key", id_col, "_th", "place", "body", "anchor", "lo", "hi", "iv", "span"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(b.num_rows):
                text = b.column(2)[i].as_py().encode()
                for e in b.column(3)[i].as_py():
                    p, start, end = unplace(e["p"])
                    out.append((e["f"], i, start, text[start:end], p - start, p - (end - LENGTH)))
            if out:
                f, i, start, body, at, lo = zip(*out, strict=True)
                take = pa.array(i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(f, pa.int64()), b.column(0).take(take), b.column(1).take(take),
                     pa.array(start, pa.int64()), pa.array(body, pa.binary()), pa.array(at, pa.int32()),
                     pa.array(lo, pa.int32()), pa.array(at, pa.int32()), pa.array([0] * len(i), pa.int32()),
                     pa.array([OFFSETS] * len(i), pa.int32())], names)

    return marked.select(id_col, "_th", "text", "edges").mapInArrow(
        run, f"key long, `{id_col}` {kind}, _th long, place long, body binary, "
             "anchor int, lo int, hi int, iv int, span int")


def _halves(rows: DataFrame) -> DataFrame:
    """Contexts by the halves of their interval of offsets that they have windows in.

    The new key is the bytes that every window of the half holds.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                half = r["span"] // 2
                for iv in (r["iv"], r["iv"] + half):
                    lo, hi = max(r["lo"], iv), min(r["hi"], iv + half - 1)
                    if lo <= hi:
                        shared = r["body"][r["anchor"] - iv:r["anchor"] + LENGTH - (iv + half - 1)]
                        key = hashlib.blake2b(shared, digest_size=8, salt=bytes((iv, half))).digest()
                        out.append(r | {"lo": lo, "hi": hi, "iv": iv, "span": half,
                                        "key": int.from_bytes(key, "little", signed=True)})
            yield pa.RecordBatch.from_pylist(out, schema=b.schema)

    return rows.mapInArrow(run, rows.schema)


def _sorted_batches(rows: DataFrame, id_col: str) -> DataFrame:
    """(id, _th, p): starts of repeated windows, found batch by batch; groups stay whole."""
    kind = rows.schema[id_col].dataType.simpleString()

    def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        texts = table.column("body").to_pylist()
        ids = table.column(id_col).combine_chunks()
        # Origin: equal for equal (id, text hash).
        who = {}
        pair = zip(ids.to_pylist(), table.column("_th").to_pylist(), strict=True)
        origin = np.array([who.setdefault(x, len(who)) for x in pair])
        begin = table.column("place").to_numpy()
        starts = repeated_windows(texts, origin, begin)
        take = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(take)), table.column("_th").combine_chunks().take(pa.array(take)),
             pa.array(begin[take] + (np.concatenate(starts) if starts else np.zeros(0, np.int64)))],
            [id_col, "_th", "p"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for b in batches:
            keys = b.column(0).to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
            offsets = np.concatenate(([0], np.cumsum([len(x.as_py()) for x in b.column(4)])))
            start = 0
            for c in range(len(cuts) - 1):
                # A new group may begin a new batch; a group that goes on stays.
                if size + offsets[cuts[c]] - offsets[start] > BATCH_BYTES and keys[cuts[c]] != last:
                    held.append(b.slice(start, cuts[c] - start))
                    yield solve(held)
                    held, size, start = [], 0, int(cuts[c])
                last = keys[cuts[c]]
            held.append(b.slice(start))
            size += int(offsets[-1] - offsets[start])
        if sum(x.num_rows for x in held):
            yield solve(held)

    parts = rows.repartition("key").sortWithinPartitions("key")
    return parts.mapInArrow(run, f"`{id_col}` {kind}, _th long, p long")


def _intervals(starts: np.ndarray, ends: np.ndarray, n: int) -> list[tuple[int, int]]:
    a, b = merge_intervals(np.maximum(starts, 0), np.minimum(ends, n))
    return list(zip(a.tolist(), b.tolist(), strict=True))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, spans (removed byte ranges), kept_sha256 (of the remaining bytes)."""
    docs = with_row_key(docs, id_col, text_col).select(id_col, "_th", text_or_empty(text_col).alias("_t"))
    every = _anchor_rows(docs, id_col)
    # Per gram hash: how often, and is it always in the same context?  Partial sums first.
    grams = (every.groupBy("f").agg(F.count(F.lit(1)).alias("k"), F.min("c").alias("c0"), F.max("c").alias("c1"))
             .where(F.col("k") > 1).select("f", (F.col("c0") == F.col("c1")).alias("alike")))
    seen = materialize(_anchor_rows(docs, id_col).join(grams, "f"), "anchors-repeated")
    mixed = seen.where(~F.col("alike"))
    of_context = materialize(mixed.groupBy("f", "c").agg(
        F.count(F.lit(1)).alias("k"), F.min(F.struct(id_col, "_th", "p")).alias("one")), "anchors-contexts")
    again = mixed.join(of_context.where(F.col("k") > 1).select("f", "c"), ["f", "c"], "left_semi")
    # One occurrence of each differing context is sorted; those that occur once are the ones to decide.
    marks = (seen.where("alike").select(id_col, "_th", "p", F.lit(None).cast("long").alias("f"))
             .unionByName(again.select(id_col, "_th", "p", F.lit(None).cast("long").alias("f")))
             .unionByName(of_context.select(f"one.{id_col}", "one._th", "one.p", "f")))
    per_doc = marks.groupBy(id_col, "_th").agg(
        F.collect_set(F.when(F.col("f").isNull(), F.col("p"))).alias("copied"),
        F.collect_set(F.when(F.col("f").isNotNull(), F.struct("f", "p"))).alias("edges"))
    any_mark = F.col("copied").isNotNull()
    joined = (join_on_row_key(docs, per_doc, id_col)
              .select(id_col, "_th", F.octet_length("_t").cast("long").alias("n_bytes"),
                      F.when(~any_mark, F.sha2(F.col("_t").cast("binary"), 256)).alias("sha"),
                      F.when(any_mark, F.col("_t")).alias("text"), "copied", "edges"))
    joined = materialize(joined, "repeat-marks")

    edges = _edge_contexts(joined.where(F.size("edges") > 0).dropDuplicates([id_col, "_th"]), id_col)
    edges = materialize(edges, "repeat-edges")
    found = None
    while True:
        large = materialize(edges.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > HOT_CONTEXTS),
                            "repeat-large")
        calm = edges.join(large.select("key"), "key", "left_anti")
        hot = edges.join(large.select("key"), "key")
        # A large group of one offset shares a whole window: all of it repeats.
        equal = hot.where(F.col("span") == 1).select(id_col, "_th", (F.col("place") + F.col("anchor") - F.col("lo")).alias("p"))
        new = _sorted_batches(calm, id_col).unionByName(equal)
        found = new if found is None else found.unionByName(new)
        hot = hot.where(F.col("span") > 1)
        if hot.limit(1).count() == 0:
            break
        edges = materialize(_halves(hot.select(*edges.columns)), "repeat-edges")
    windows = (found.groupBy(id_col, "_th").agg(F.collect_set("p").alias("windows")))

    final = join_on_row_key(joined.where(F.size("edges") > 0), windows, id_col)
    settled = joined.where(F.coalesce(F.size("edges"), F.lit(0)) <= 0).withColumn(
        "windows", F.lit(None).cast("array<long>"))
    rows = settled.unionByName(final.select(*settled.columns))
    kind = docs.schema[id_col].dataType.simpleString()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for n, sha, text, copied, windows in zip(*(b.column(i).to_pylist() for i in range(1, 6)), strict=True):
                if text is None:
                    out.append((n, [], sha))
                    continue
                body = text.encode()
                _, start, end = unplace(np.array(copied or [], np.int64))
                w = np.array(windows or [], np.int64)
                spans = _intervals(np.concatenate((start, w)), np.concatenate((end, w + LENGTH)), len(body))
                out.append((n, spans, sha256_hex(kept_bytes(body, spans))))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x[0] for x in out], pa.int64()),
                 pa.array([[{"start": s, "end": e} for s, e in x[1]] for x in out], spans_type),
                 pa.array([x[2] for x in out], pa.string())], [id_col, "n_bytes", "spans", "kept_sha256"])

    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return rows.select(id_col, "n_bytes", "sha", "text", "copied", "windows").mapInArrow(
        finish, f"`{id_col}` {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept_sha256 string")


def digest(spans: str = "spans") -> list:
    """The columns of the contract from the spans."""
    return [F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("n_removed"),
            F.size(spans).cast("long").alias("n_spans")]
