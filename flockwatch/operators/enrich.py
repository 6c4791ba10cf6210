"""Dimension lookups, eligibility and the typed trade table (ops 11-17, 22, 23, 24i)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flockwatch.functions.keys import (
    CASCADE_SOURCES, cascade_key, labelled_cascade, parse_yyyymmdd, strict_double,
)
from flockwatch.session import materialize

# Fixed values that must equal the reference's: the feed filter lists.
#   sides kept: S, R
#   feed codes rejected: ALBRIDGE, BROADRIDGE, ETF
#   feed descriptions rejected: BrightScope, LEGACY
#   feed locations rejected: NPB
# The trust-code list is deployment data and has no default here; pass it as
# ``trust_codes``.
DEFAULT_SIDES = ("S", "R")
DEFAULT_EXCLUDED_FEED_CODES = ("ALBRIDGE", "BROADRIDGE", "ETF")
DEFAULT_EXCLUDED_FEED_DESCS = ("BrightScope", "LEGACY")
DEFAULT_EXCLUDED_LOCATIONS = ("NPB",)


def dedupe_dimension(dim: DataFrame, key: str, values: list[str]) -> DataFrame:
    """One row per key.  Duplicate keys keep the greatest value tuple, so the
    choice does not depend on partition order (the reference keeps whichever
    row came last)."""
    picked = F.max(F.struct(*[F.col(v) for v in values])).alias("_v")
    return (dim.filter(F.col(key).isNotNull()).groupBy(key).agg(picked)
               .select(key, *[F.col(f"_v.{v}").alias(v) for v in values]))


def lookup(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str,
           values: list[str], on_missing: str = "error", label: str | None = None) -> DataFrame:
    """Op 23: attach ``values`` of ``dim`` where ``dim_key`` equals ``fact_key``.

    ``on_missing="error"``: a fact key absent from the dimension fails the job,
    in any row that later filters on fact columns do not remove first;
    ``"flag"``: the guard is left to the caller, who finds the message for an
    unknown key (else NULL) in the column ``_missing``;
    ``"drop"``: such rows are dropped (inner join).  Dimensions are small and
    are broadcast by adaptive execution when their measured size allows.
    """
    return _attach(fact, dedupe_dimension(dim, dim_key, values), fact_key, dim_key, on_missing, label or dim_key)


def _attach(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, on_missing: str, label: str) -> DataFrame:
    """``lookup`` in a dimension with one row per key."""
    d = dim.withColumnRenamed(dim_key, "_lk_key")
    if on_missing == "drop":
        return fact.join(d, F.col(fact_key) == F.col("_lk_key"), "inner").drop("_lk_key")
    if on_missing not in ("error", "flag"):
        raise ValueError(f"on_missing must be 'error', 'flag' or 'drop', not {on_missing!r}")
    d = d.withColumn("_lk_hit", F.lit(True))
    out = fact.join(d, F.col(fact_key) == F.col("_lk_key"), "left")
    msg = F.concat(F.lit(f"key not found in {label}: "), F.coalesce(F.col(fact_key).cast("string"),
                                                                     F.lit("NULL")))
    unknown = F.col("_lk_hit").isNull()
    if on_missing == "flag":
        before = F.col("_missing") if "_missing" in fact.columns else F.lit(None).cast("string")
        return out.withColumn("_missing", F.coalesce(before, F.when(unknown, msg))).drop("_lk_key", "_lk_hit")
    # A filter, so that the guard holds whichever columns are read.
    return out.filter(F.when(unknown, F.raise_error(msg).cast("boolean")).otherwise(True)).drop("_lk_key", "_lk_hit")


def eligibility(side: Column, feed_code: Column, feed_desc: Column, feed_location: Column,
                trust_code: Column, trust_codes, sides=DEFAULT_SIDES,
                excluded_feed_codes=DEFAULT_EXCLUDED_FEED_CODES,
                excluded_feed_descs=DEFAULT_EXCLUDED_FEED_DESCS,
                excluded_locations=DEFAULT_EXCLUDED_LOCATIONS) -> Column:
    """Op 22: conjunctive, case-sensitive eligibility predicate."""
    if not trust_codes:
        raise ValueError("trust_codes is empty: no trade would be eligible")
    return (side.isin(*sides)
            & ~feed_code.isin(*excluded_feed_codes)
            & ~feed_desc.isin(*excluded_feed_descs)
            & ~feed_location.isin(*excluded_locations)
            & trust_code.isin(*trust_codes))


def build_trades(raw: DataFrame, side_dim: DataFrame, acct_dim: DataFrame, trust_dim: DataFrame,
                 feed_dim: DataFrame, trust_codes, on_missing: str = "error",
                 sides=DEFAULT_SIDES, excluded_feed_codes=DEFAULT_EXCLUDED_FEED_CODES,
                 excluded_feed_descs=DEFAULT_EXCLUDED_FEED_DESCS,
                 excluded_locations=DEFAULT_EXCLUDED_LOCATIONS) -> DataFrame:
    """Raw text fact -> eligible typed trades (ops 11-17, 22, 23).

    Lookups: side code by trade class key; trust key by product account, trust
    code by trust key; feed code, description and location by feed key.  Under
    ``on_missing="error"`` an unknown key in any row fails the job, whether or
    not the row is eligible: guard and eligibility are one predicate over all
    four lookups, which cannot sink below any of them.

    Feeds are the largest dimension, so their lookup may shuffle the fact.  A
    row that side or trust rule out takes only its feed key there, for the
    guard.  Dimensions are written once, so that joins see their real size.
    """
    keep = eligibility(F.col("trade_class_code"), F.col("feed_code"), F.col("feed_desc"),
                       F.col("feed_location_code"), F.col("trust_code"), trust_codes, sides,
                       excluded_feed_codes, excluded_feed_descs, excluded_locations)
    df = raw.select("trade_class_key", "prdct_acct_key", "sdm_feed_key", "trade_date_key",
                    cascade_key(*CASCADE_SOURCES).alias("acct_key"), "shareclass_cusip_key", "exec_reltn_key",
                    "clearing_reltn_key", "trading_entity_key", "usd_gross_amt")
    strict = on_missing == "error"
    on_missing = "flag" if strict else on_missing

    def attach(df, dim, fact_key, dim_key, values, label):
        written = materialize(dedupe_dimension(dim, dim_key, values), "dimension")
        return _attach(df, written, fact_key, dim_key, on_missing, label)

    df = attach(df, side_dim, "trade_class_key", "trade_class_key", ["trade_class_code"], "side dimension")
    df = attach(df, acct_dim.withColumnRenamed("acct_key", "_acct_dim_key"), "prdct_acct_key",
                "_acct_dim_key", ["trust_key"], "account dimension")
    df = attach(df, trust_dim.withColumnRenamed("trust_key", "_trust_dim_key"), "trust_key",
                "_trust_dim_key", ["trust_code"], "trust dimension")
    taken = F.col("trade_class_code").isin(*sides) & F.col("trust_code").isin(*trust_codes)
    df = df.select(*[c if c in ("sdm_feed_key", "_missing") else F.when(taken, F.col(c)).alias(c) for c in df.columns])
    df = attach(df, feed_dim.withColumnRenamed("sdm_feed_key", "_feed_dim_key"), "sdm_feed_key",
                "_feed_dim_key", ["feed_code", "feed_desc", "feed_location_code"], "feed dimension")
    if strict:
        keep = F.when(F.col("_missing").isNotNull(),
                      F.raise_error(F.col("_missing")).cast("boolean")).otherwise(keep)
    return df.filter(keep).select(
        parse_yyyymmdd("trade_date_key").alias("trade_date"),
        F.col("prdct_acct_key").alias("fund"),
        F.col("trade_class_code").alias("side"),
        F.col("acct_key"),
        F.col("shareclass_cusip_key").alias("share_class_key"),
        F.col("exec_reltn_key").alias("executing_key"),
        F.col("clearing_reltn_key").alias("clearing_key"),
        F.col("trading_entity_key"),
        strict_double("usd_gross_amt").alias("usd_gross_amt"),
        F.col("sdm_feed_key").alias("feed_key"),
    )


def account_key_sources(raw: DataFrame) -> DataFrame:
    """Op 24i: over the unfiltered fact, distinct (account key, source column)."""
    lab = labelled_cascade()
    return raw.select(lab.acct_key.alias("acct_key"), lab.source.alias("source")).distinct()
