"""Hard-negative mining by slot-decomposed selection.

An anchor's positives are its best rows of the same label; each positive with
score u admits the rows of other labels with low * u <= 100 * score <= high * u,
and the best of them are its hard negatives.  The windows of one anchor's
positives overlap.  Their upper limits, in descending order, split the scores
into disjoint slots; every row falls into one slot at most.  Combiners keep the
best k rows per slot, partial lists merge slot by slot, and a positive's answer
is the head of the merged slots from its own downwards, cut at its lower limit.

All anchors meet all rows in blocks (a stated query set, no cross join):
anchors are dealt into groups and rows into slices of bounded size, and a task
takes one group against one slice as integer matrix products.  What a task
sends on is at most k rows per anchor and slot.

Defined cases: rows with a null id, label or vector, or with a null or
non-finite component, take no part; equal rows count once; different rows of
one id each stand for themselves, ordered by a hash of their content after the
id, and are no partners of each other; vectors of unequal length meet on
their common components; components and scores beyond 64 bits stop at the
ends of that range; an anchor without positives has no rows; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flockwatch.session import materialize

ANCHORS_A_GROUP = 2048
ROWS_A_SLICE = 8192
# Scores of a block of anchors by rows that are held at once.
BLOCK_ANCHORS, BLOCK_ROWS = 256, 4096
LEAST = np.iinfo(np.int64).min


def quantised(vectors: DataFrame, vec_col: str = "embedding", steps: int = 256) -> DataFrame:
    """``vectors`` whose vector is there and finite, with ``q`` = floor(steps * component)."""
    v = F.col(vec_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(v.isNotNull() & finite).withColumn(
        "q", F.transform(v, lambda x: F.floor(F.lit(steps) * x.cast("double"))))


def hard_negatives(items: DataFrame, n_positives: int = 5, n_negatives: int = 5,
                   low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``items``: (id long, label, q array of long, is_anchor boolean).
    """
    items = (items.where("id is not null and label is not null and q is not null")
             .select("id", F.col("label").cast("string").alias("label"), "q",
                     F.coalesce("is_anchor", F.lit(False)).alias("is_anchor"))
             .distinct().withColumn("h", F.xxhash64("label", "q")))
    items = materialize(items, "mining-items")
    anchors = items.where("is_anchor").drop("is_anchor")
    n_rows, n_anchors = items.count(), anchors.count()
    n_slices, n_groups = -(-n_rows // ROWS_A_SLICE) or 1, -(-n_anchors // ANCHORS_A_GROUP) or 1
    rows = (items.select(*[F.col(c).alias(c) for c in ("id", "label", "q", "h")]).withColumn("s", F.pmod("h", F.lit(n_slices)).cast("int"))
            .withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1)))))

    def by_cell(df):
        return df.withColumn("g", F.pmod(F.xxhash64("id", "h"), F.lit(n_groups)).cast("int")).withColumn(
            "s", F.explode(F.sequence(F.lit(0), F.lit(n_slices - 1)))).groupBy("g", "s")

    def positives(a: pa.Table, b: pa.Table) -> pa.Table:
        return _table(*_best_positives(_Rows(a), _Rows(b), n_positives))

    def negatives(a: pa.Table, b: pa.Table) -> pa.Table:
        return _table(*_best_negatives(_Rows(a), _Rows(b), a.column("limits").to_pylist(), n_negatives, low, high))

    best = Window.partitionBy("anchor", "anchor_h", "slot").orderBy(F.desc("score"), "id", "h")
    pos = (by_cell(anchors).cogroup(rows.groupBy("g", "s")).applyInArrow(positives, _SCHEMA)
           .withColumn("n", F.row_number().over(best)).where(F.col("n") <= n_positives))
    pos = materialize(pos.select("anchor", "anchor_h", "n", "id", "score"), "positives")

    # The limits of an anchor, descending: slot j ends at limit j and begins above limit j + 1.
    limits = pos.groupBy("anchor", "anchor_h").agg(
        F.reverse(F.array_sort(F.collect_list("score"))).alias("limits"))
    seekers = anchors.join(limits, (F.col("id") == F.col("anchor")) & (F.col("h") == F.col("anchor_h"))).drop("anchor", "anchor_h")
    neg = (by_cell(seekers).cogroup(rows.groupBy("g", "s")).applyInArrow(negatives, _SCHEMA)
           .withColumn("n", F.row_number().over(best)).where(F.col("n") <= n_negatives))
    merged = neg.groupBy("anchor", "anchor_h").agg(F.array_sort(F.collect_list(
        F.struct("slot", (-F.col("score")).alias("down"), "id", "h", "score"))).alias("found"))
    # Slots descend, and within one the scores do: the suffix from a positive's slot is its window's order.
    window = F.slice(F.filter("found", lambda x: (x["slot"] >= F.col("n") - 1)
                              & (F.lit(low).cast("decimal(5,0)") * F.col("score") <= F.lit(100).cast("decimal(5,0)") * x["score"])),
                     1, n_negatives)
    return (pos.join(merged, ["anchor", "anchor_h"])
            .select(F.col("anchor").alias("anchor_id"), F.col("id").alias("positive_id"),
                    F.col("score").alias("positive_score"), F.posexplode(window).alias("at", "x"))
            .select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"),
                    F.col("x.id").alias("negative_id"), "positive_score", F.col("x.score").alias("negative_score")))


_SCHEMA = "anchor long, anchor_h long, slot int, id long, h long, score long"


class _Rows:
    """One side of a cell, in order of id and hash, as numpy columns."""

    def __init__(self, t: pa.Table):
        self.id, self.h = (t.column(c).to_numpy() for c in ("id", "h"))
        self.label = np.array(t.column("label").to_pylist(), dtype=object)
        q = t.column("q").combine_chunks()
        sizes, flat = q.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), q.flatten().to_numpy(zero_copy_only=False)
        width = int(sizes.max()) if len(sizes) else 0
        self.q = np.zeros((len(sizes), width), dtype=np.int64)
        self.q[np.arange(width) < sizes[:, None]] = flat
        self.order = np.lexsort((self.h, self.id))

    def sorted(self) -> _Rows:
        for name in ("id", "h", "label", "q"):
            setattr(self, name, getattr(self, name)[self.order])
        return self


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: by floating point where no sum can pass 2^53, else by Python integers."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    if float(np.abs(a.astype(np.float64)).max()) * float(np.abs(b.astype(np.float64)).max()) * width < 2.0 ** 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, LEAST + 1, -LEAST - 1).astype(np.int64)


def _top(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best allowed entries of each row; ties go to the smaller column."""
    s = np.where(allowed, scores, LEAST)
    if s.shape[1] > k:
        kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        allowed = allowed & (s >= kth[:, None])
    r, c = np.nonzero(allowed)
    order = np.lexsort((c, -s[r, c], r))
    r, c = r[order], c[order]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    return r[place < k], c[place < k]


def _blocks(n: int, size: int):
    return [slice(i, min(i + size, n)) for i in range(0, n, size)]


def _best_positives(a: _Rows, b: _Rows, k: int):
    """Per anchor the best k rows of its label, other ids, in this cell."""
    b = b.sorted()
    out = []
    for label in set(a.label.tolist()) & set(b.label.tolist()):
        of_a, of_b = np.flatnonzero(a.label == label), np.flatnonzero(b.label == label)
        for x in _blocks(len(of_a), BLOCK_ANCHORS):
            for y in _blocks(len(of_b), BLOCK_ROWS):
                i, j = of_a[x], of_b[y]
                s = _scores(a.q[i], b.q[j])
                r, c = _top(s, a.id[i][:, None] != b.id[j][None, :], k)
                out.append((i[r], np.zeros(len(r), np.int32), j[c], s[r, c]))
    return a, b, out


def _best_negatives(a: _Rows, b: _Rows, limits: list[list[int]], k: int, low: int, high: int):
    """Per anchor and slot the best k rows of other labels in this cell."""
    b = b.sorted()
    out = []
    if not len(a.id) or not len(b.id):
        return a, b, out
    names, number = np.unique(np.concatenate((a.label, b.label)).astype(str), return_inverse=True)
    label_a, label_b = number[:len(a.id)], number[len(a.id):]
    most = max(map(len, limits))
    # Python integers: the products stay exact.  An absent limit makes an empty slot.
    upper = np.full((len(limits), most + 1), LEAST, dtype=np.int64)
    lower = np.full((len(limits), most), -LEAST - 1, dtype=np.int64)
    for i, u in enumerate(limits):
        upper[i, :len(u)] = [max(high * x // 100, LEAST + 1) for x in u]
        lower[i, :len(u)] = [max(-(-low * x // 100), LEAST + 1) for x in u]
    for x in _blocks(len(a.id), BLOCK_ANCHORS):
        for y in _blocks(len(b.id), BLOCK_ROWS):
            s = _scores(a.q[x], b.q[y])
            other = (label_a[x][:, None] != label_b[y][None, :]) & (a.id[x][:, None] != b.id[y][None, :])
            for slot in range(most):
                fits = other & (s <= upper[x, slot][:, None]) & (s > upper[x, slot + 1][:, None]) & (s >= lower[x, slot][:, None])
                r, c = _top(s, fits, k)
                out.append((r + x.start, np.full(len(r), slot, np.int32), c + y.start, s[r, c]))
    return a, b, out


def _table(a: _Rows, b: _Rows, found: list) -> pa.Table:
    empty = np.zeros(0, np.int64)
    i, slot, j, score = (np.concatenate([f[n] for f in found]) if found else empty for n in range(4))
    i, j = i.astype(np.int64), j.astype(np.int64)
    return pa.table({"anchor": pa.array(a.id[i], pa.int64()), "anchor_h": pa.array(a.h[i], pa.int64()),
                     "slot": pa.array(slot, pa.int32()), "id": pa.array(b.id[j], pa.int64()),
                     "h": pa.array(b.h[j], pa.int64()), "score": pa.array(score, pa.int64())})
