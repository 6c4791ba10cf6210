"""Embedding near-duplicates by collision counting on one-dimensional projections.

Every vector is projected on many random directions.  Comparing all vectors
within a window of one projection would list a third of all pairs, so candidates
come from random-hyperplane buckets instead: each projection is cut at zero, and
a table is ``k`` projections whose halves form a bucket.  Pairs that share a
bucket of any table are then counted: a projection is a collision when the
partner lies in the window centred on the vector.  Pairs with enough collisions
are verified by their cosine in double precision.

A cut through the origin parts two vectors with probability ``angle / pi``
wherever the vectors lie, so ``tables`` gives the number of tables that miss a
pair exactly at the threshold with probability ``MISS`` at most, on clustered
and off-centre vectors too; window and count depend on the distance alone and
lose less than one in a thousand.  Closer pairs are missed less often.  Vectors
that lie close together make large buckets: ``k`` is at least log2 of the number
of vectors and larger where a sample shows that this saves work; the number of
tables follows, so that the miss rate stays.

Equal vectors are one node with a multiplicity.  Buckets above ``BLOCK`` nodes
are dealt in blocks, and pairs of blocks meet in tasks of bounded size.  Tasks
do not list pairs: they return, per node, the linked vectors counted in this
bucket first, and one edge to the component found there.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing; vectors of different lengths never link;
repeated rows are vectors of their own, linked as equals; null ids name a
component only if no other id is in it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flockwatch.llm.graph import components, local_roots
from flockwatch.session import materialize

COSINE = 0.95
MISS = 0.005
COUNTED = 64                # projections on which collisions are counted
SAMPLE = 4096               # vectors from which the size of buckets is foreseen
ROW_COST = 256              # comparisons that cost as much as one more bucket row
MAX_CUTS = 40               # projections per table
BLOCK = 256                 # nodes of a bucket that meet in one group
TILE = 64                   # rows whose cosines are taken at once
SEED = 20


def tables(n: int, cosine: float = COSINE, miss: float = MISS, sample: np.ndarray | None = None) -> tuple[int, int]:
    """(projections per table, tables) for n vectors; ``sample`` holds cosines of random pairs of them."""
    def count(k: int) -> int:
        return math.ceil(math.log(miss) / math.log(1 - (1 - math.acos(cosine) / math.pi) ** k))

    least = max(4, math.ceil(math.log2(max(n, 2))))
    if sample is None or len(sample) == 0:
        return least, count(least)
    same = 1 - np.arccos(np.clip(sample, -1, 1)) / math.pi
    k = min(range(least, max(MAX_CUTS, least) + 1), key=lambda k: count(k) * (ROW_COST + n / 2 * float((same ** k).mean())))
    return k, count(k)


def sampled_cosines(sample: pa.Array) -> np.ndarray:
    """Cosines of pairs in a sample in random order."""
    out = []
    for _, at in _by_length(sample):
        x = unit(sample.take(pa.array(at)))
        out += [(x[gap:] * x[:-gap]).sum(axis=1) for gap in range(1, min(9, len(x)))]
    return np.concatenate(out) if out else np.zeros(0)


def window_and_count(cosine: float = COSINE) -> tuple[float, int]:
    """Half width of the window that a pair at the threshold leaves with probability 0.1, and the least count."""
    distance = math.sqrt(2 - 2 * cosine)
    mean, spread = 0.9 * COUNTED, math.sqrt(0.09 * COUNTED)
    return 1.645 * distance, math.floor(mean - 3.3 * spread)


def directions(dim: int, count: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((count, dim)).T


def unit(column: pa.Array) -> np.ndarray:
    """Rows of unit length in double precision, from a list column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)        # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def bucket_ids(projected: np.ndarray, k: int, n_tables: int) -> np.ndarray:
    """A bucket id per vector and table."""
    bits = projected[:, :k * n_tables] > 0
    ids = bits.reshape(len(projected), n_tables, k) @ (1 << np.arange(k, dtype=np.int64))
    return ids * n_tables + np.arange(n_tables)


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    lengths = np.diff(np.asarray(column.offsets)) if len(column) else np.zeros(0, int)
    for dim in np.unique(lengths):
        yield int(dim), np.flatnonzero(lengths == dim)


def _bucket_rows(nodes: DataFrame, k: int, n_tables: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, at in _by_length(b.column(1)):
                part = b.take(pa.array(at))
                r = directions(dim, max(k * n_tables, COUNTED))
                ids = bucket_ids(unit(part.column(1)) @ r, k, n_tables)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids.ravel()), pa.array(np.full(ids.size, dim, np.int32)),
                     part.column(0).take(pa.array(np.repeat(np.arange(len(at)), n_tables)))], ["bucket", "dim", "node"])

    return nodes.select("node", "v").mapInArrow(run, "bucket long, dim int, node long")


def _linked_pairs(a: np.ndarray, b: np.ndarray, x, projected, ids, table, cosine: float) -> np.ndarray:
    """Which pairs of rows pass the count and the cosine and met in no earlier table."""
    half, least = window_and_count(cosine)
    out = np.zeros(len(a), bool)
    for s in range(0, len(a), 4096):
        p, q = a[s:s + 4096], b[s:s + 4096]
        collisions = (np.abs(projected[p, :COUNTED] - projected[q, :COUNTED]) <= half).sum(axis=1)
        near = collisions >= least
        p, q = p[near], q[near]
        same = ids[p] == ids[q]
        ok = (same.argmax(axis=1) == table[p]) & ((x[p] * x[q]).sum(axis=1) >= cosine)
        out[s + np.flatnonzero(near)[ok]] = True
    return out


def _solve(batch: pa.RecordBatch, k: int, n_tables: int, cosine: float) -> pa.RecordBatch:
    """(node, links, root) of a batch of whole groups, sorted by group."""
    bucket, dim, lo, hi, block, node, copies = (batch.column(i).to_numpy() for i in range(7))
    n = batch.num_rows
    group = np.cumsum(np.concatenate(([0], ((bucket[1:] != bucket[:-1]) | (dim[1:] != dim[:-1]) | (lo[1:] != lo[:-1])
                                            | (hi[1:] != hi[:-1])).astype(np.int64)))) if n else np.zeros(0, np.int64)
    links, root = np.zeros(n, np.int64), np.arange(n)
    for d, at in _by_length(batch.column(7)):
        x = unit(batch.column(7).take(pa.array(at)))
        r = directions(d, max(k * n_tables, COUNTED))
        projected = x @ r
        ids = bucket_ids(projected, k, n_tables)
        g, blk, cross = group[at], block[at], lo[at] != hi[at]
        table = bucket[at] % n_tables
        first, second = [], []
        for s in range(0, len(at), TILE):
            # Rows of a tile against all rows up to the end of its last group; products leave the near pairs.
            e = int(np.searchsorted(g, g[min(s + TILE, len(at)) - 1], side="right"))
            i, j = np.nonzero((x[s:s + TILE] @ x[s:e].T >= cosine - 1e-9) & (g[s:s + TILE, None] == g[s:e]))
            i, j = i[i < j] + s, j[i < j] + s
            apart = ~cross[i] | (blk[i] != blk[j])
            i, j = i[apart], j[apart]
            ok = _linked_pairs(i, j, x, projected, ids, table, cosine)
            first.append(i[ok])
            second.append(j[ok])
        if first:
            a, b = at[np.concatenate(first)], at[np.concatenate(second)]
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            root = local_roots(n, np.concatenate((a, np.arange(n))), np.concatenate((b, root)))
    keep = np.flatnonzero(links > 0)
    return pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(links[keep]), pa.array(node[root[keep]])],
                                      ["node", "links", "root"])


def _count_links(groups: DataFrame, k: int, n_tables: int, cosine: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            # Everything up to the last group's start is whole.
            key = np.stack([b.column(i).to_numpy().astype(np.int64) for i in range(4)])
            change = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            before = tuple(c[-1].as_py() for c in held[-1].columns[:4]) if held else None
            now = tuple(c[0].as_py() for c in b.columns[:4]) if b.num_rows else None
            if held and before != now:
                yield _solve(_joined(held), k, n_tables, cosine)
                held, size = [], 0
            if len(change) and size + b.num_rows > 4 * BLOCK:
                held.append(b.slice(0, int(change[-1])))
                yield _solve(_joined(held), k, n_tables, cosine)
                held, size = [b.slice(int(change[-1]))], b.num_rows - int(change[-1])
            elif b.num_rows:
                held.append(b)
                size += b.num_rows
        if held:
            yield _solve(_joined(held), k, n_tables, cosine)

    parts = (groups.repartition("bucket", "dim", "lo", "hi")
             .sortWithinPartitions("bucket", "dim", "lo", "hi"))
    return parts.select("bucket", "dim", "lo", "hi", "block", "node", "copies", "v").mapInArrow(
        run, "node long, links long, root long")


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                    cosine: float = COSINE) -> DataFrame:
    """One row per vector: id, n_links, component_id (smallest id reachable), kept (id names its component)."""
    spark = vectors.sparkSession
    v = F.col(vec_col).cast("array<double>")
    fine = (F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists(v, lambda x: x != 0))
    rows = vectors.select(F.col(id_col), F.when(F.coalesce(fine, F.lit(False)), v).alias("v"))
    rows = rows.withColumn("node", F.when(F.col("v").isNotNull(), F.xxhash64("v")))
    nodes = materialize(rows.where(F.col("node").isNotNull()).groupBy("node")
                        .agg(F.count(F.lit(1)).alias("copies"), F.min(id_col).alias("least"), F.first("v").alias("v")),
                        "vector-nodes")
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
    k, n_tables = tables(nodes.count(), cosine, sample=sampled_cosines(sample))
    held = _bucket_rows(nodes, k, n_tables)
    shared = held.groupBy("bucket", "dim").agg(F.count(F.lit(1)).alias("b")).where(F.col("b") > 1)
    blocks = F.ceil(F.col("b") / BLOCK).cast("int")
    met = (materialize(held.join(shared, ["bucket", "dim"]), "vector-buckets")
           .withColumn("block", F.pmod(F.xxhash64("node", "bucket"), blocks).cast("int"))
           .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
           .withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
           .join(nodes.select("node", "copies", "v"), "node"))
    found = materialize(_count_links(met, k, n_tables, cosine), "vector-links")
    comps = components(found.where(F.col("node") != F.col("root")).select(F.col("node").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = (nodes.select("node", "copies", "least").join(sums, "node", "left").join(comps, "node", "left")
             .withColumn("comp", F.coalesce("comp", "node")))
    smallest = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    per_node = named.join(smallest, "comp").select(
        "node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))
    out = rows.select(id_col, "node").join(per_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col(id_col)).otherwise(F.col("component_id"))
    return out.select(id_col, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"),
                      F.coalesce(F.col(id_col) == component, F.lit(True)).alias("kept"))
