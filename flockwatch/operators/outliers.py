"""Rolling-window outlier detection (ops 25-29)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flockwatch.functions.stats import guarded_z
from flockwatch.operators.activity import align_to_period, daily_activity, with_daily_share
from flockwatch.session import materialize

# Fixed values that must equal the reference's: trailing window of 90 days back
# (the frame holds 91 days, the current one included), threshold z >= 2.
WINDOW_DAYS = 90
Z_THRESHOLD = 2.0
# The reference's index period: 2013-01-01 to 2016-02-01, end exclusive.
REFERENCE_PERIOD = ("2013-01-01", "2016-02-01")

GROUP_KEYS = ["trade_date", "fund", "side"]
BROADCAST_ROWS = 200_000    # flagged groups up to which they are broadcast
STAT_COLUMNS = ["trade_date", "fund", "side", "n_accts", "total", "mean", "std_dev", "z"]


def rolling_stats(shared: DataFrame, window_days: int = WINDOW_DAYS) -> DataFrame:
    """Op 26: trailing mean and sample sd of the share per (fund, side).

    Frame: days D-window_days .. D, both ends included; only days the key traded
    are rows, so untraded days never enter the sums.  One sort per (fund, side);
    a partition holds at most one row per calendar day, whatever the data size.
    n=1 gives sd 0 (Spark's NULL is mapped to 0).
    """
    w = Window.partitionBy("fund", "side").orderBy("_day").rangeBetween(-window_days, 0)
    # The day number is a column first, so that both statistics share one window and one sort.
    return (shared.withColumn("_day", F.unix_date("trade_date"))
            .withColumns({"mean": F.avg("share").over(w),
                          "std_dev": F.coalesce(F.stddev_samp("share").over(w), F.lit(0.0))})
            .drop("_day"))


def scored_groups(trades: DataFrame, start=None, end=None, window_days: int = WINDOW_DAYS,
                  approx: bool = False) -> DataFrame:
    """Ops 24f, 24g, 18, 26, 19: every (day, fund, side) with its z-score."""
    aligned = align_to_period(trades.select("trade_date", "fund", "side", "acct_key"), start, end)
    act = daily_activity(aligned, approx=approx)
    stats = rolling_stats(with_daily_share(act), window_days)
    return stats.select(
        "trade_date", "fund", "side", "n_accts", "total", "mean", "std_dev",
        guarded_z("n_accts", "total", "mean", "std_dev").alias("z"))


def outlier_groups(trades: DataFrame, start=None, end=None, window_days: int = WINDOW_DAYS,
                   threshold: float = Z_THRESHOLD, approx: bool = False) -> DataFrame:
    """Op 27: groups whose z reaches the threshold (upper side only, >=)."""
    return scored_groups(trades, start, end, window_days, approx).filter(F.col("z") >= threshold)


def outlier_trades(trades: DataFrame, start=None, end=None, window_days: int = WINDOW_DAYS,
                   threshold: float = Z_THRESHOLD) -> DataFrame:
    """Ops 28-29: flagged groups joined back to all trade columns, distinct rows.

    The flagged groups are written first, so that their size is known.  When
    they are few they are broadcast, and no other trade is shuffled for the
    join; else adaptive execution splits skewed keys.
    """
    flagged = materialize(outlier_groups(trades, start, end, window_days, threshold), "flagged_groups")
    if flagged.count() <= BROADCAST_ROWS:
        flagged = F.broadcast(flagged)
    return flagged.join(trades, GROUP_KEYS, "inner").distinct()


STORE_KEY = "trade_period"


def store_trades(trades: DataFrame, path: str, unit: str = "day") -> None:
    """The trades as a table partitioned by the day (or ``unit``) of the trade.

    Rows are rebalanced on the partition key: a small period ends in one file,
    a hot one is split over several tasks and files.
    """
    dated = trades.withColumn(STORE_KEY, F.to_date(F.date_trunc(unit, "trade_date")))
    dated.hint("rebalance", STORE_KEY).write.mode("overwrite").partitionBy(STORE_KEY).parquet(path)


def stored_outlier_trades(spark: SparkSession, path: str, scored: DataFrame, unit: str = "day",
                          threshold: float = Z_THRESHOLD) -> DataFrame:
    """Op 28 over a table of ``store_trades``: only periods with a flagged group are read.

    ``scored`` is the written table of scored groups.  The join carries the
    partition key, so that its broadcast side prunes the scan's partitions at
    run time (dynamic partition pruning); a flagged side too large to
    broadcast joins by sorting, without the pruning.
    """
    flagged = scored.filter(F.col("z") >= threshold).withColumn(STORE_KEY, F.to_date(F.date_trunc(unit, "trade_date")))
    return (spark.read.parquet(path).join(flagged, [STORE_KEY, "trade_date", "fund", "side"])
            .drop(STORE_KEY).distinct())


def flagged_preview(flagged: DataFrame, n: int = 20) -> DataFrame:
    """Ops 24h, 24j: the most active flagged groups first (a top-n report).

    Ordered by accounts descending with a full tie-break, so the n rows are
    deterministic; Spark plans it as a per-partition top-n and one merge.
    """
    return flagged.orderBy(F.col("n_accts").desc(), "trade_date", "fund", "side").limit(n)
