"""Daily activity and daily totals (ops 18, 24f, 24g, 25)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flockwatch.functions.stats import share_of_total


def align_to_period(trades: DataFrame, start: _dt.date | str | None = None,
                    end: _dt.date | str | None = None, date_col: str = "trade_date") -> DataFrame:
    """Op 25: keep observations on the daily index [start, end); no densifying.

    The bounds are literals, so the filter reaches the Parquet scan.
    """
    c = F.col(date_col)
    if start is not None:
        trades = trades.filter(c >= F.lit(start).cast("date"))
    if end is not None:
        trades = trades.filter(c < F.lit(end).cast("date"))
    return trades


def daily_activity(trades: DataFrame, approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """Op 24f: distinct accounts per (day, fund, side) as a double.

    The distinct count runs as a two-level aggregate keyed by the account too, so
    one hot (day, fund, side) group is spread over many tasks.
    """
    agg = (F.approx_count_distinct("acct_key", rsd) if approx else F.countDistinct("acct_key"))
    return (trades.groupBy("trade_date", "fund", "side")
                  .agg(agg.cast("double").alias("n_accts")))


SKETCH_LG_K = 12


def activity_sketches(trades: DataFrame, lg_k: int = SKETCH_LG_K) -> DataFrame:
    """Op 24f, approximate: a mergeable sketch of the accounts of each (day, fund, side).

    A sketch takes at most 2^lg_k bytes or so however many accounts it saw; the
    table is written once and serves every later period without a rescan.
    """
    return trades.groupBy("trade_date", "fund", "side").agg(F.hll_sketch_agg("acct_key", F.lit(lg_k)).alias("accounts"))


def accounts_in_period(sketches: DataFrame, start=None, end=None, keys: tuple = ("fund", "side")) -> DataFrame:
    """Distinct accounts per ``keys`` over the days of [start, end), from merged sketches: (keys, n_accts).

    The relative standard error is 1.04 / sqrt(2^lg_k): 1.6% at lg_k = 12.
    Sketches hold small counts (some hundreds) all but exactly.
    """
    return (align_to_period(sketches, start, end).groupBy(*keys)
            .agg(F.hll_sketch_estimate(F.hll_union_agg("accounts")).alias("n_accts")))


def daily_totals(activity: DataFrame) -> DataFrame:
    """Op 24g: per (day, side) the sum of per-fund distinct counts.

    An account active in two funds counts twice, as in the reference.  The
    result has one row per (day, side): its size is bounded by the calendar.
    """
    return activity.groupBy("trade_date", "side").agg(F.sum("n_accts").alias("total"))


def with_daily_share(activity: DataFrame) -> DataFrame:
    """Op 23b + 18: attach each day's total and the fund's share of it.

    The total is a window sum over (day, side) on the activity table, so the
    trades are scanned once (an aggregate joined back would scan them twice).
    A window partition holds one row per fund active that day, whatever the
    trade volume.
    """
    w = Window.partitionBy("trade_date", "side")
    out = activity.withColumn("total", F.sum("n_accts").over(w))
    return out.withColumn("share", share_of_total("n_accts", "total"))
