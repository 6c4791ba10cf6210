"""Participation runs: consecutive model trades a member took part in (op 44)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flockwatch.operators.ranking import group_positions

TRADE_KEYS = ["trade_date", "fund", "side"]


def model_events(model_trades: DataFrame) -> DataFrame:
    """Each model's trades numbered 0..N-1 by (date, fund, side), with N."""
    mt = model_trades.select("model_id", *TRADE_KEYS).distinct()
    ev = group_positions(mt, ["model_id"], TRADE_KEYS, "event_idx")
    n = mt.groupBy("model_id").agg(F.count(F.lit(1)).alias("n_events"))
    return ev.join(n, "model_id")


def participation_runs(basket_members: DataFrame, model_members: DataFrame,
                       model_trades: DataFrame, include_open: bool = False) -> DataFrame:
    """Op 44: maximal runs of consecutive model trades in which a member traded.

    "Consecutive" counts model trades (across funds and sides), not calendar
    days.  Faithful default (checked formula): with N events, a run ending at
    event e of length L is reported iff e < N-1 and (L > 1 or e = N-2); its
    flag is 1 iff e = N-2 — the reference commits a run only at a non-trading
    event and never reports one still open at the last event.
    ``include_open=True`` (D9): runs ending at N-1 are reported with flag 1
    whatever their length; other runs only when L > 1, with flag 0.
    """
    ev = model_events(model_trades)
    members = model_members.select("model_id", "acct_key").distinct()
    traded = (ev.join(basket_members.select(*TRADE_KEYS, "acct_key").distinct(), TRADE_KEYS)
                .join(members, ["model_id", "acct_key"]))
    # Gaps and islands: within (model, account) the event index minus the
    # running count is constant along a run.  A (model, account) partition
    # holds at most one row per event of that model.
    w = Window.partitionBy("model_id", "acct_key").orderBy("event_idx")
    isl = traded.withColumn("_grp", F.col("event_idx") - F.row_number().over(w))
    runs = (isl.groupBy("model_id", "acct_key", "_grp")
               .agg(F.min("event_idx").alias("first_idx"), F.max("event_idx").alias("last_idx"),
                    F.count(F.lit(1)).alias("run_length"),
                    F.min_by("trade_date", "event_idx").alias("first_date"),
                    F.max_by("trade_date", "event_idx").alias("last_date"),
                    F.first("n_events").alias("n_events")))
    e, n, length = F.col("last_idx"), F.col("n_events"), F.col("run_length")
    if include_open:
        keep = (e == n - 1) | (length > 1)
        flag = (e == n - 1)
    else:
        keep = (e < n - 1) & ((length > 1) | (e == n - 2))
        flag = (e == n - 2)
    return runs.filter(keep).select("model_id", "acct_key", "first_date", "last_date",
                                    "run_length", flag.cast("int").alias("last_flag"))
