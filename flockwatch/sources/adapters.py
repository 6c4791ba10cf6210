"""Driver tables seen as trades.

The test data is a TPC-H-like star schema.  These adapters present it in the
trade schema the analytics expect, so every registered query reads the given
tables and its work grows with them.

Trade schema (``TRADE_COLUMNS``): one row per account-level trade.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRADE_COLUMNS = [
    "trade_date", "fund", "side", "acct_key", "share_class_key", "executing_key",
    "clearing_key", "trading_entity_key", "usd_gross_amt", "feed_key",
]
GROUP_KEYS = ["trade_date", "fund", "side"]

# Sides kept by the adapters: l_returnflag A and R play the two trade sides.
ADAPTER_SIDES = ("A", "R")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").filter(F.col("l_returnflag").isin(*ADAPTER_SIDES))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")


def _common(df: DataFrame, fund: F.Column, acct: F.Column) -> DataFrame:
    return df.select(
        F.col("l_shipdate").cast("date").alias("trade_date"),
        fund.alias("fund"),
        F.col("l_returnflag").alias("side"),
        acct.alias("acct_key"),
        F.col("l_partkey").cast("string").alias("share_class_key"),
        F.col("l_suppkey").cast("string").alias("executing_key"),
        F.col("l_linestatus").alias("clearing_key"),
        F.col("o_orderpriority").alias("trading_entity_key"),
        F.col("l_extendedprice").alias("usd_gross_amt"),
        F.col("l_linenumber").cast("string").alias("feed_key"),
    )


def trades_by_supplier_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter A (sparse accounts): fund = supplier nation, account = customer."""
    li, od = _lineitem(spark, sf_dir), _orders(spark, sf_dir)
    su = load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    # Suppliers first: side, day and fund are known before the orders come.
    df = li.join(su, li.l_suppkey == su.s_suppkey, "inner").join(od, li.l_orderkey == od.o_orderkey, "inner")
    return _common(df, F.concat(F.lit("N"), F.col("s_nationkey").cast("string")),
                   F.col("o_custkey").cast("string"))


def trades_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter A3 (dense sets): fund = market segment, account = customer nation."""
    li, od = _lineitem(spark, sf_dir), _orders(spark, sf_dir)
    cu = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    # Orders meet customers first: they are fewer and narrower than line items.
    df = li.join(od.join(cu, od.o_custkey == cu.c_custkey, "inner"), li.l_orderkey == od.o_orderkey, "inner")
    return _common(df, F.col("c_mktsegment"), F.col("c_nationkey").cast("string"))


# The same adapters as SQL text for the DuckDB oracle.
SQL_TRADES_A = """
select cast(l_shipdate as date) trade_date, 'N' || cast(s_nationkey as varchar) fund,
       l_returnflag side, cast(o_custkey as varchar) acct_key,
       cast(l_partkey as varchar) share_class_key, cast(l_suppkey as varchar) executing_key,
       l_linestatus clearing_key, o_orderpriority trading_entity_key,
       l_extendedprice usd_gross_amt, cast(l_linenumber as varchar) feed_key
from lineitem join orders on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey
where l_returnflag in ('A', 'R')
"""

SQL_TRADES_A3 = """
select cast(l_shipdate as date) trade_date, c_mktsegment fund,
       l_returnflag side, cast(c_nationkey as varchar) acct_key,
       cast(l_partkey as varchar) share_class_key, cast(l_suppkey as varchar) executing_key,
       l_linestatus clearing_key, o_orderpriority trading_entity_key,
       l_extendedprice usd_gross_amt, cast(l_linenumber as varchar) feed_key
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
where l_returnflag in ('A', 'R')
"""


# ---------------------------------------------------------------------------
# Raw fact + dimension tables (the text-typed input of the ingest path).
# ---------------------------------------------------------------------------

def raw_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Driver tables as the raw, all-text fact table of the ingest path.

    Account identifiers are synthesised from the customer key so that every
    branch of the cascade occurs: bin number absent ("-998") when the key is a
    multiple of 3, external key absent ("-999") for multiples of 5, alias absent
    ("") for multiples of 7, client key absent ("") for multiples of 11.  Every
    row is kept; these rules only shape the values.
    """
    li = load(spark, sf_dir, "lineitem")
    od = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    df = li.join(od, li.l_orderkey == od.o_orderkey, "inner")
    ck = F.col("o_custkey")
    cks = ck.cast("string")
    return df.select(
        F.date_format("l_shipdate", "yyyyMMdd").alias("trade_date_key"),
        F.col("l_suppkey").cast("string").alias("prdct_acct_key"),
        F.col("l_returnflag").alias("trade_class_key"),
        F.col("l_partkey").cast("string").alias("shareclass_cusip_key"),
        F.when(ck % 3 == 0, F.lit("-998")).otherwise(F.concat(F.lit("B"), cks)).alias("bin_number"),
        F.when(ck % 5 == 0, F.lit("-999")).otherwise(F.concat(F.lit("E"), cks)).alias("ext_acct_key"),
        F.when(ck % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("R"), cks)).alias("rep_alias_key"),
        F.when(ck % 11 == 0, F.lit("")).otherwise(F.concat(F.lit("C"), cks)).alias("client_acct_key"),
        F.col("l_partkey").cast("string").alias("sdm_feed_key"),
        F.col("l_suppkey").cast("string").alias("exec_reltn_key"),
        F.col("l_linestatus").alias("clearing_reltn_key"),
        F.col("o_orderpriority").alias("trading_entity_key"),
        F.col("l_extendedprice").cast("string").alias("usd_gross_amt"),
    )


SQL_RAW_FACT = """
select strftime(l_shipdate, '%Y%m%d') trade_date_key,
       cast(l_suppkey as varchar) prdct_acct_key,
       l_returnflag trade_class_key,
       cast(l_partkey as varchar) shareclass_cusip_key,
       case when o_custkey % 3 = 0 then '-998' else 'B' || cast(o_custkey as varchar) end bin_number,
       case when o_custkey % 5 = 0 then '-999' else 'E' || cast(o_custkey as varchar) end ext_acct_key,
       case when o_custkey % 7 = 0 then '' else 'R' || cast(o_custkey as varchar) end rep_alias_key,
       case when o_custkey % 11 = 0 then '' else 'C' || cast(o_custkey as varchar) end client_acct_key,
       cast(l_partkey as varchar) sdm_feed_key,
       cast(l_suppkey as varchar) exec_reltn_key,
       l_linestatus clearing_reltn_key,
       o_orderpriority trading_entity_key,
       l_extendedprice usd_gross_amt_num
from lineitem join orders on l_orderkey = o_orderkey
"""


def side_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side dimension derived from the fact: return flag A plays subscriptions (S)."""
    li = load(spark, sf_dir, "lineitem")
    return (li.select(F.col("l_returnflag").alias("trade_class_key")).distinct()
              .select("trade_class_key",
                      F.when(F.col("trade_class_key") == "A", F.lit("S"))
                       .otherwise(F.col("trade_class_key")).alias("trade_class_code")))


def account_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product account -> trust: supplier -> its nation."""
    su = load(spark, sf_dir, "supplier")
    return su.select(F.col("s_suppkey").cast("string").alias("acct_key"),
                     F.col("s_nationkey").cast("string").alias("trust_key"))


def trust_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trust -> trust code: nation -> region name."""
    na = load(spark, sf_dir, "nation")
    re_ = load(spark, sf_dir, "region")
    return (na.join(re_, na.n_regionkey == re_.r_regionkey, "inner")
              .select(F.col("n_nationkey").cast("string").alias("trust_key"),
                      F.col("r_name").alias("trust_code")))


def feed_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed -> (code, description, location): part -> (brand, type, size)."""
    pa = load(spark, sf_dir, "part")
    return pa.select(F.col("p_partkey").cast("string").alias("sdm_feed_key"),
                     F.col("p_brand").alias("feed_code"),
                     F.col("p_type").alias("feed_desc"),
                     F.col("p_size").cast("string").alias("feed_location_code"))


# Eligibility lists used with the driver tables (same roles as the reference's
# feed, description, location and trust lists; see operators.enrich).
ADAPTER_ELIGIBILITY = dict(
    sides=("S", "R"),
    excluded_feed_codes=("Brand#1", "Brand#2", "Brand#3"),
    excluded_feed_descs=("PROMO",),
    excluded_locations=("1",),
    trust_codes=("AMERICA", "EUROPE", "ASIA"),
)
