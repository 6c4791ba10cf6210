"""Sharding by longest-processing-time scheduling.

Rows of equal text form a group that must stay together.  Groups sorted by
size go, largest first, to the least-loaded shard, which a heap yields.

At scale there are as many groups as documents, so the heap never sees them
one by one.  Only groups above ``total / (n_shards * FINE)`` bytes (at most
``n_shards * FINE`` of them) are scheduled alone; all smaller groups are first
bundled by their hash into ``LEVELS * WIDTH`` bundles whose expected sizes
halve from level to level.  Large groups and bundles together are a few
thousand items whatever the input, and the smallest bundles, placed last, even
the shards out to about ``total / 2**LEVELS / WIDTH`` bytes.

Slots number the rows of a shard without gaps.  They come from counts per
(shard, sub-range of the row hash) and a row number inside each sub-range, so
neither a shard nor a hot group is ever one task's work.

Defined cases: a null text counts 0 bytes, groups with the empty text and has
CRC 0; null ids sort first; repeated rows get slots of their own; an empty
table gives an empty result; input columns named like an output column are
replaced by it.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flockwatch.llm.common import text_or_empty
from flockwatch.session import materialize

FINE = 64       # large groups: at most n_shards * FINE
LEVELS = 10     # bundle levels of halving size
WIDTH = 128     # bundles per level
SUBS = 256      # sub-ranges of a shard, for numbering its rows
ROW_OVERHEAD = 16


def lpt(items: list[tuple[int, int]], n_shards: int) -> dict[int, int]:
    """(bytes, key) items -> key to shard; largest first onto the least-loaded shard."""
    heap = [(0, s) for s in range(n_shards)]
    placed = {}
    for size, key in sorted(items, key=lambda x: (-x[0], x[1])):
        load, shard = heapq.heappop(heap)
        placed[key] = shard
        heapq.heappush(heap, (load + size, shard))
    return placed


def _bundle(h: Column) -> Column:
    """Bundle id of a group hash: level by halving probability, then one of WIDTH."""
    r = F.pmod(F.shiftright(h, 20), F.lit(1 << LEVELS))
    level = F.floor(-F.log2((F.lit(1 << LEVELS) - r) / F.lit(float(1 << LEVELS))))
    return (level * WIDTH + F.pmod(h, F.lit(WIDTH))).cast("long")


def shard_documents(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``docs`` with size, text_crc32, law, shard, slot and grown_shard.

    The law is ``bytes``: shard sizes are near equal (as far as groups that
    must stay together allow).  ``grown_shard`` is null under this law.
    """
    spark = docs.sparkSession
    text = text_or_empty(text_col)
    rows = docs.drop("size", "text_crc32", "law", "shard", "slot", "grown_shard").withColumns({
        "size": (F.octet_length(text) + ROW_OVERHEAD).cast("long"),
        "text_crc32": F.crc32(text.cast("binary")),
        "_h": F.xxhash64(text),
        "_sub": F.pmod(F.xxhash64(F.col(id_col), text), F.lit(SUBS))})
    # One row per group; partial sums first, so a hot group is a few rows by the shuffle.
    groups = materialize(rows.groupBy("_h").agg(F.sum("size").alias("bytes")), "shard-groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    limit = total // (n_shards * FINE)
    big = [(r["bytes"], r["_h"]) for r in groups.where(F.col("bytes") > limit).collect()]
    small = [(r["bytes"], r["b"]) for r in groups.where(F.col("bytes") <= limit)
             .groupBy(_bundle(F.col("_h")).alias("b")).agg(F.sum("bytes").alias("bytes")).collect()]
    placed = lpt([(n, (0, k)) for n, k in big] + [(n, (1, k)) for n, k in small], n_shards)
    # Bounded tables: n_shards * FINE and (LEVELS + 1) * WIDTH rows at most.
    of_group = spark.createDataFrame([(k, s) for (kind, k), s in placed.items() if kind == 0],
                                     "_g long, _gs int")
    of_bundle = spark.createDataFrame([(k, s) for (kind, k), s in placed.items() if kind == 1],
                                      "_b long, _bs int")
    dealt = (rows.join(F.broadcast(of_group), F.col("_h") == F.col("_g"), "left")
             .join(F.broadcast(of_bundle), _bundle(F.col("_h")) == F.col("_b"), "left")
             .withColumn("shard", F.coalesce("_gs", "_bs").cast("int")))
    before = Window.partitionBy("_os").orderBy("_ou").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (dealt.groupBy(F.col("shard").alias("_os"), F.col("_sub").alias("_ou")).count()
               .select("_os", "_ou", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_off")))
    within = Window.partitionBy("shard", "_sub").orderBy(id_col, "_h", "size")
    keep = [c for c in docs.columns if c not in ("size", "text_crc32", "law", "shard", "slot", "grown_shard")]
    return (dealt.withColumn("_n", F.row_number().over(within) - 1)
            # n_shards * SUBS rows at most.
            .join(F.broadcast(offsets), (F.col("shard") == F.col("_os")) & (F.col("_sub") == F.col("_ou")))
            .select(*keep, "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("_off") + F.col("_n")).cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))
