"""Trade analysis reports per model trade (ops 41-43)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flockwatch.functions.keys import format_yyyymmdd

TRADE_KEYS = ["trade_date", "fund", "side"]
FIRM_KEYS = TRADE_KEYS + ["executing_key", "clearing_key"]
ENTITY_KEYS = TRADE_KEYS + ["trading_entity_key"]


def normalise_for_matching(flagged_trades: DataFrame) -> DataFrame:
    """Op 41: the flagged trades with the date also as ``yyyyMMdd`` text.

    Fund and side are separate columns already, so nothing is stripped from a
    packed key; joins use the real date column.
    """
    return flagged_trades.withColumn("trade_date_text", format_yyyymmdd("trade_date"))


def _analysis(flagged_trades: DataFrame, model_trades: DataFrame, keys: list[str]) -> DataFrame:
    # Aggregate the trades once per group, then attach the models claiming the
    # trade key.  A key claimed by k models keeps its own sum on each model row
    # (the reference multiplies it by k, D10).
    agg = (flagged_trades.groupBy(*keys)
           .agg(F.countDistinct("acct_key").cast("double").alias("n_accts"),
                F.sum("usd_gross_amt").alias("sum_usd")))
    # One aggregate row per group and one row per (model, trade key): the join
    # output is already distinct, so no further de-duplication is needed.
    mt = model_trades.select("model_id", "min_size", *TRADE_KEYS).distinct()
    return agg.join(mt, TRADE_KEYS).select("model_id", "min_size", *keys, "n_accts", "sum_usd")


def trade_analysis_firm(flagged_trades: DataFrame, model_trades: DataFrame) -> DataFrame:
    """Op 42: per model trade and (executing, clearing) firm: accounts and USD."""
    return _analysis(flagged_trades, model_trades, FIRM_KEYS)


def trade_analysis_entity(flagged_trades: DataFrame, model_trades: DataFrame) -> DataFrame:
    """Op 43: per model trade and trading entity: accounts and USD, all 8 columns (D11)."""
    return _analysis(flagged_trades, model_trades, ENTITY_KEYS)


def as_text_lines(report: DataFrame) -> DataFrame:
    """The reports' export form: comma-joined fields, USD as ``%.2f``."""
    cols = [F.col(c).cast("string") for c in report.columns if c != "sum_usd"]
    return report.select(F.concat_ws(",", *cols, F.format_string("%.2f", "sum_usd")).alias("value"))
