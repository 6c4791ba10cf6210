"""Positions in a total order without funnelling rows through one task.

``row_number()`` over an unpartitioned window, or over one hot group, runs in a
single task.  Here rows are range-partitioned on the order key, numbered inside
each partition, and shifted by the row counts of the partitions before them
(a table with one row per partition).  The numbered rows are written once to
the shared checkpoint folder, so every consumer sees the same numbering.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flockwatch.session import materialize

_LOCAL_BITS = 33  # monotonically_increasing_id: partition id above bit 33


def global_positions(df: DataFrame, order_cols: list[str], name: str = "pos",
                     partitions: int | None = None) -> DataFrame:
    """Attach the 0-based position of each row in the order of ``order_cols``.

    ``order_cols`` must be a total order (break ties in the caller).
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
                .withColumn("_mid", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_pid", F.shiftright("_mid", _LOCAL_BITS)).withColumn(
        "_loc", F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)))
    # Range bounds come from a sample; pin one evaluation so the counts and the
    # rows below see the same partitioning.
    ranged = materialize(ranged, "positions")
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    # One row per partition: a bounded table, ordered in a single small window.
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"))
    return (ranged.join(F.broadcast(offsets), "_pid")
                  .withColumn(name, F.col("_off") + F.col("_loc"))
                  .drop("_mid", "_pid", "_loc", "_off"))


def group_positions(df: DataFrame, group_cols: list[str], order_cols: list[str],
                    name: str = "pos", partitions: int | None = None) -> DataFrame:
    """0-based position of each row inside its group, by ``order_cols``.

    A group larger than a partition is spread over several tasks.
    """
    g = global_positions(df, group_cols + order_cols, "_gpos", partitions)
    first = g.groupBy(*group_cols).agg(F.min("_gpos").alias("_gfirst"))
    return (g.join(first, group_cols).withColumn(name, F.col("_gpos") - F.col("_gfirst"))
             .drop("_gpos", "_gfirst"))
