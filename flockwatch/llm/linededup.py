"""Line deduplication with a sharded minimal perfect hash.

Lines are known by a 128-bit hash of their key.  A line matters if its key is
in at least two documents; its owner is the smallest id that holds it.  The
hashes of these lines are cut into shards, and each shard becomes one row:
a minimal perfect hash (displacements per bucket) that sends its n hashes to
the slots 0..n-1, and arrays over the slots: fingerprint, number of documents'
occurrences, and owner.

Documents do not join lines.  Their line hashes travel, as narrow probes, to
the shard they fall in and look themselves up in the arrays; only positions to
drop travel back.  Probes of a busy shard are dealt over several copies of it,
so that a line found in a third of all documents is not one task's work, and a
task streams its probes past one shard at a time.

Defined cases: a null or empty text is one empty line; keys below
``MIN_POINTS`` code points never drop; a line stays where its owner's id is,
also when it repeats there; documents without id own no line, and lose lines
owned by others; repeated rows are one document; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flockwatch.llm.common import SPACES, ascii_lower, join_on_row_key, text_or_empty, with_row_key
from flockwatch.session import materialize

MIN_POINTS = 10
SHARD_KEYS = 16_384         # keys of a shard on average
COPY_PROBES = 20_000        # probes for which a shard gets one more copy
LOAD = 4                    # keys per bucket of the perfect hash

_MIX = np.uint64(0xFF51AFD7ED558CCD)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _slot(h: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """Slot of hash ``h`` under displacement ``d`` among ``n``."""
    with np.errstate(over="ignore"):
        x = (h ^ (d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * _MIX
        x ^= x >> np.uint64(32)
        x *= _MIX
        return ((x >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def build_perfect_hash(h: np.ndarray) -> np.ndarray:
    """Displacement per bucket so that the distinct hashes fill the slots 0..n-1 without collision.

    Hash, displace: buckets in order of falling size try displacements until
    their keys all fall on free slots.
    """
    n = len(h)
    buckets = max(1, -(-n // LOAD))
    of = _bucket(h, buckets)
    order = np.argsort(of, kind="stable")
    counts = np.bincount(of, minlength=buckets)
    first = np.concatenate(([0], np.cumsum(counts)))
    taken = np.zeros(n, bool)
    disp = np.zeros(buckets, np.uint32)
    step = np.arange(256, dtype=np.uint64)
    for b in np.argsort(-counts, kind="stable"):
        k = counts[b]
        if k == 0:
            break
        keys = h[order[first[b]:first[b + 1]]]
        base = 0
        while True:
            tries = _slot(np.repeat(keys[None, :], len(step), 0), (step + np.uint64(base))[:, None], n)
            free = ~taken[tries].any(axis=1)
            if k > 1:
                row = np.sort(tries, axis=1)
                free &= (row[:, 1:] != row[:, :-1]).all(axis=1)
            good = np.flatnonzero(free)
            if len(good):
                disp[b] = base + good[0]
                taken[tries[good[0]]] = True
                break
            base += len(step)
    return disp


def look_up(h: np.ndarray, disp: np.ndarray, n: int) -> np.ndarray:
    """The slots of hashes; for hashes that were not indexed, any slot."""
    return _slot(h, disp[_bucket(h, len(disp))], n)


def _index_shards(keys: DataFrame, owner_type: str) -> DataFrame:
    """(shard, disp, prints, counts, owners): one row per shard from (shard, h1, h2, count, owner)."""
    def build(table: pa.Table) -> pa.Table:
        h = table.column("h1").to_numpy().view(np.uint64)
        disp = build_perfect_hash(h)
        slot = look_up(h, disp, len(h))
        back = np.empty(len(h), np.int64)
        back[slot] = np.arange(len(h))
        take = pa.array(back)
        return pa.table({
            "shard": table.column("shard").slice(0, 1),
            "disp": pa.array([disp.tobytes()], pa.binary()),
            "prints": pa.array([table.column("h2").to_numpy()[back].tobytes()], pa.binary()),
            "counts": pa.array([table.column("count").to_numpy()[back].tobytes()], pa.binary()),
            "owners": pa.ListArray.from_arrays(pa.array([0, len(h)], pa.int32()),
                                               table.column("owner").combine_chunks().take(take))})

    return keys.groupBy("shard").applyInArrow(
        build, f"shard long, disp binary, prints binary, counts binary, owners array<{owner_type}>")


def _probe(parts: DataFrame, id_col: str, id_type: str) -> DataFrame:
    """(id, _th, pos) of the lines to drop; a partition holds shard rows before their probes, in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, disp, prints, owners = None, None, None, None
        for b in batches:
            shard, copy, head = (b.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero((shard[1:] != shard[:-1]) | (copy[1:] != copy[:-1]) | (head[1:] != head[:-1])) + 1
            cuts = [0, *cuts.tolist(), b.num_rows]
            keep = np.zeros(b.num_rows, bool)
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi == lo:
                    continue
                if head[lo] == 0:
                    at = (shard[lo], copy[lo])
                    disp = np.frombuffer(b.column(7)[lo].as_py(), np.uint32)
                    prints = np.frombuffer(b.column(8)[lo].as_py(), np.int64)
                    owners = b.column(9)[lo].values
                elif at == (shard[lo], copy[lo]):
                    h = b.column(3).slice(lo, hi - lo).to_numpy().view(np.uint64)
                    slot = look_up(h, disp, len(prints))
                    found = prints[slot] == b.column(4).slice(lo, hi - lo).to_numpy()
                    other = pa.compute.not_equal(owners.take(pa.array(slot)), b.column(5).slice(lo, hi - lo))
                    keep[lo:hi] = found & pa.compute.fill_null(other, True).to_numpy(zero_copy_only=False)
            take = pa.array(np.flatnonzero(keep))
            lines = b.column(6).take(take)
            yield pa.RecordBatch.from_arrays([b.column(5).take(take), lines.field(0), lines.field(1)],
                                             [id_col, "_th", "pos"])

    return parts.mapInArrow(run, f"`{id_col}` {id_type}, _th long, pos int")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_lines, n_dropped, kept (the remaining text)."""
    id_type = docs.schema[id_col].dataType.simpleString()
    docs = with_row_key(docs, id_col, text_col).select(id_col, "_th", F.split(text_or_empty(text_col), "\n", -1).alias("_l"))
    lines = (docs.select(id_col, "_th", F.posexplode("_l").alias("pos", "line"))
             .withColumn("k", line_key(F.col("line"))).where(F.length("k") >= MIN_POINTS)
             .select(id_col, "_th", "pos", F.xxhash64("k").alias("h1"),
                     F.xxhash64(F.lit(7), "k").alias("h2")))
    # Partial sums first: a line found everywhere is one row per map task.
    held = (lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("count"), F.min(id_col).alias("owner"),
                                          F.max(id_col).alias("last"), F.max(F.col(id_col).isNull()).alias("null_id"))
            .where((F.col("owner") < F.col("last")) | (F.col("owner").isNotNull() & F.col("null_id"))))
    held = materialize(held.select("h1", "h2", "count", "owner"), "line-keys")
    sums = held.agg(F.count(F.lit(1)).alias("keys"), F.sum("count").alias("lines")).first()
    n_shards = max(1, -(-sums["keys"] // SHARD_KEYS))
    # Sharding by one half of the hash and indexing by the other keeps equal halves apart.
    shard = F.pmod(F.xxhash64(F.lit(3), "h2"), F.lit(n_shards))
    held = held.withColumn("shard", shard)
    index = _index_shards(held.dropDuplicates(["shard", "h1"]), id_type)
    # Copies of a shard: for the probes of its own lines, and for its share of the lines that are not in the index.
    total = docs.agg(F.sum(F.size("_l"))).first()[0] or 0
    others = (total - (sums["lines"] or 0)) // n_shards
    copies = held.groupBy("shard").agg((1 + F.floor((F.sum("count") + others) / COPY_PROBES)).cast("long").alias("copies"))
    index = materialize(index.join(copies, "shard"), "line-index")
    empty = {"h1": "long", "h2": "long", id_col: id_type, "line": "struct<th:long,pos:int>"}
    heads = index.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"),
                         F.lit(0).alias("head"), *[F.lit(None).cast(t).alias(c) for c, t in empty.items()],
                         "disp", "prints", "owners")
    of_shard = index.select("shard", "copies")
    probes = (lines.withColumn("shard", shard).join(of_shard, "shard")
              .select("shard", F.pmod(F.xxhash64(id_col, "_th"), F.col("copies")).alias("copy"), F.lit(1).alias("head"),
                      "h1", "h2", id_col, F.struct(F.col("_th").alias("th"), "pos").alias("line"),
                      F.lit(None).cast("binary").alias("disp"), F.lit(None).cast("binary").alias("prints"),
                      F.lit(None).cast(f"array<{id_type}>").alias("owners")))
    parts = (heads.unionByName(probes).repartition("shard", "copy")
             .sortWithinPartitions("shard", "copy", "head"))
    drops = _probe(parts, id_col, id_type).groupBy(id_col, "_th").agg(F.collect_set("pos").alias("_drop"))
    out = join_on_row_key(docs, drops, id_col)
    gone = F.coalesce("_drop", F.array().cast("array<int>"))
    # Positions are looked up in a hash set, so a document's work is in proportion to its lines.
    stay = F.array_except(F.sequence(F.lit(0), F.size("_l") - 1), gone)
    kept = F.transform(stay, lambda i: F.get("_l", i))
    return out.select(id_col, F.size("_l").cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_dropped"),
                      F.array_join(F.when(F.size(gone) == 0, F.col("_l")).otherwise(kept), "\n").alias("kept"))
