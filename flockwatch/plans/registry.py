"""Registered queries: name -> (spark, sf_dir) -> DataFrame, with oracle SQL.

Every query reads the driver tables (through the adapters) over whole tables.
Doubles derived by floating sums are rounded to 9 places in both the Spark
result and the oracle SQL, so that engines that add in another order still
hash equal.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flockwatch.functions import keys
from flockwatch.operators import activity, outliers
from flockwatch.sources import adapters as ad

ROUND = 9

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn
    return deco


def _round(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*[F.round(c, ROUND).alias(c) if c in cols else F.col(c) for c in df.columns])


# ---------------------------------------------------------------------------
# Outlier detection (ops 18, 19, 24f, 24g, 25-29)
# ---------------------------------------------------------------------------

_SQL_SCORED = """
with t as ({trades}),
a as (select trade_date, fund, side, cast(count(distinct acct_key) as double) n_accts
      from t group by trade_date, fund, side),
tot as (select trade_date, side, sum(n_accts) total from a group by trade_date, side),
r as (select a.trade_date, a.fund, a.side, a.n_accts, tot.total,
             case when a.n_accts is null or tot.total is null then 0.0 else a.n_accts / tot.total end share
      from a left join tot on a.trade_date = tot.trade_date and a.side = tot.side),
w as (select *, avg(share) over x mean, coalesce(stddev_samp(share) over x, 0) std_dev from r
      window x as (partition by fund, side order by trade_date
                   range between interval '90' day preceding and current row)),
s as (select trade_date, fund, side, n_accts, total, mean, std_dev,
             case when total > 0 and std_dev > 0 then (n_accts / total - mean) / std_dev else 0 end z
      from w)
"""

SQL_OUTLIER_GROUPS = (_SQL_SCORED.format(trades=ad.SQL_TRADES_A) + """
select trade_date, fund, side, n_accts, total, round(mean, 9) mean, round(std_dev, 9) std_dev,
       round(z, 9) z
from s where z >= 2
""")


@register("outlier_groups", SQL_OUTLIER_GROUPS)
def q_outlier_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: flagged (day, fund, side) groups, adapter A."""
    df = outliers.outlier_groups(ad.trades_by_supplier_nation(spark, sf_dir))
    return _round(df, "mean", "std_dev", "z")


flagship = q_outlier_groups


@register("outlier_groups_dense", _SQL_SCORED.format(trades=ad.SQL_TRADES_A3) + """
select trade_date, fund, side, n_accts, total, round(mean, 9) mean, round(std_dev, 9) std_dev,
       round(z, 9) z
from s where z >= 2
""")
def q_outlier_groups_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged groups, adapter A3 (the input of the set queries)."""
    df = outliers.outlier_groups(ad.trades_by_segment(spark, sf_dir))
    return _round(df, "mean", "std_dev", "z")


@register("outlier_trades", _SQL_SCORED.format(trades=ad.SQL_TRADES_A) + """
select distinct s.trade_date, s.fund, s.side, s.n_accts, s.total, round(s.mean, 9) mean,
       round(s.std_dev, 9) std_dev, round(s.z, 9) z, t.acct_key, t.share_class_key,
       t.executing_key, t.clearing_key, t.trading_entity_key, t.usd_gross_amt, t.feed_key
from s join t on s.trade_date = t.trade_date and s.fund = t.fund and s.side = t.side
where s.z >= 2
""")
def q_outlier_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ops 28-29: flagged groups with all trade columns (adapter A)."""
    df = outliers.outlier_trades(ad.trades_by_supplier_nation(spark, sf_dir))
    return _round(df, "mean", "std_dev", "z")


@register("outlier_trades_stored", ORACLE_SQL["outlier_trades"])
def q_outlier_trades_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 28 over trades stored by month: partitions without a flagged group are not read (adapter A)."""
    from flockwatch.session import materialize, scratch_path
    trades = ad.trades_by_supplier_nation(spark, sf_dir)
    path = scratch_path(spark, "trades_by_month")
    outliers.store_trades(trades, path, "month")
    scored = materialize(outliers.scored_groups(trades), "scored_groups")
    return _round(outliers.stored_outlier_trades(spark, path, scored, "month"), "mean", "std_dev", "z")


@register("accounts_by_year_sketched", """
with t as ({})
select cast(year(trade_date) as integer) as year, fund, side, count(distinct acct_key) n_exact, true as within_bound
from t group by 1, 2, 3
""".format(ad.SQL_TRADES_A))
def q_accounts_by_year_sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 24f, approximate: yearly accounts from merged daily sketches, held against the exact count (three standard errors)."""
    trades = ad.trades_by_supplier_nation(spark, sf_dir)
    keys = ["year", "fund", "side"]
    year = F.year("trade_date").alias("year")
    merged = activity.accounts_in_period(activity.activity_sketches(trades).select("*", year), keys=tuple(keys))
    exact = trades.select("*", year).groupBy(*keys).agg(F.countDistinct("acct_key").alias("n_exact"))
    bound = F.greatest(F.lit(1.0), 3 * 1.04 / F.sqrt(F.lit(2.0 ** activity.SKETCH_LG_K)) * F.col("n_exact"))
    return exact.join(merged, keys).select(*keys, "n_exact", (F.abs(F.col("n_accts") - F.col("n_exact")) <= bound).alias("within_bound"))


@register("daily_activity", """
with t as ({}) select trade_date, fund, side, cast(count(distinct acct_key) as double) n_accts
from t group by trade_date, fund, side
""".format(ad.SQL_TRADES_A))
def q_daily_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.daily_activity(ad.trades_by_supplier_nation(spark, sf_dir))


@register("daily_totals", """
with t as ({}),
a as (select trade_date, fund, side, cast(count(distinct acct_key) as double) n_accts
      from t group by trade_date, fund, side)
select trade_date, side, sum(n_accts) total from a group by trade_date, side
""".format(ad.SQL_TRADES_A))
def q_daily_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.daily_totals(activity.daily_activity(ad.trades_by_supplier_nation(spark, sf_dir)))


@register("rolling_stats", _SQL_SCORED.format(trades=ad.SQL_TRADES_A) + """
select trade_date, fund, side, n_accts, total, round(mean, 9) mean, round(std_dev, 9) std_dev,
       round(z, 9) z from s
""")
def q_rolling_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ops 25-26 + 19 for every group (unfiltered)."""
    df = outliers.scored_groups(ad.trades_by_supplier_nation(spark, sf_dir))
    return _round(df, "mean", "std_dev", "z")


# ---------------------------------------------------------------------------
# Ingest: text round trip, keys, lookups, eligibility (ops 1-4, 11-17, 22, 23, 24i)
# ---------------------------------------------------------------------------

from flockwatch.operators import enrich  # noqa: E402
from flockwatch.session import materialize, scratch_path  # noqa: E402
from flockwatch.sources import delimited, sinks  # noqa: E402


def _write_pipe_text(spark: SparkSession, df: DataFrame, name: str) -> str:
    """Write ``df`` as pipe-delimited text with a header line per file."""
    path = scratch_path(spark, name)
    line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])
    sinks.write_lines(df.select(line.alias("value")), path, header="|".join(df.columns))
    return path


def _ingested_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw_path = _write_pipe_text(spark, ad.raw_fact(spark, sf_dir), "raw_fact")
    dims = {}
    for name, fn in [("side", ad.side_dimension), ("acct", ad.account_dimension),
                     ("trust", ad.trust_dimension), ("feed", ad.feed_dimension)]:
        p = _write_pipe_text(spark, fn(spark, sf_dir), f"dim_{name}")
        dims[name] = delimited.read_delimited(spark, p, delim_regex=r"\|")
    raw = delimited.read_fixed_delimited(spark, raw_path, "|")
    return enrich.build_trades(raw, dims["side"], dims["acct"], dims["trust"], dims["feed"],
                               on_missing="error", **ad.ADAPTER_ELIGIBILITY)


_SQL_CASCADE = """coalesce(
  case when bin_number in ('', '-998', '-999') then null else bin_number end,
  case when ext_acct_key in ('', '-998', '-999') then null else ext_acct_key end,
  case when rep_alias_key in ('', '-998', '-999') then null else rep_alias_key end,
  case when client_acct_key in ('', '-998', '-999') then null else client_acct_key end,
  'INVALID_KEY')"""

_SQL_SOURCE = """case
  when bin_number not in ('', '-998', '-999') then 'bin_number'
  when ext_acct_key not in ('', '-998', '-999') then 'ext_acct_key'
  when rep_alias_key not in ('', '-998', '-999') then 'rep_alias_key'
  when client_acct_key not in ('', '-998', '-999') then 'client_acct_key'
  else 'ERROR' end"""

SQL_ELIGIBLE = f"""
with f as ({ad.SQL_RAW_FACT}),
sd as (select distinct l_returnflag k,
              case when l_returnflag = 'A' then 'S' else l_returnflag end code from lineitem),
ac as (select cast(s_suppkey as varchar) k, cast(s_nationkey as varchar) trust_key from supplier),
tr as (select cast(n_nationkey as varchar) k, r_name code
       from nation join region on n_regionkey = r_regionkey),
fe as (select cast(p_partkey as varchar) k, p_brand fc, p_type fd, cast(p_size as varchar) fl
       from part)
select cast(strptime(f.trade_date_key, '%Y%m%d') as date) trade_date, f.prdct_acct_key fund,
       sd.code side, {_SQL_CASCADE} acct_key, f.shareclass_cusip_key share_class_key,
       f.exec_reltn_key executing_key, f.clearing_reltn_key clearing_key,
       f.trading_entity_key, f.usd_gross_amt_num usd_gross_amt, f.sdm_feed_key feed_key
from f join sd on f.trade_class_key = sd.k
       join ac on f.prdct_acct_key = ac.k
       join tr on ac.trust_key = tr.k
       join fe on f.sdm_feed_key = fe.k
where sd.code in ('S', 'R') and fe.fc not in ('Brand#1', 'Brand#2', 'Brand#3')
  and fe.fd not in ('PROMO') and fe.fl not in ('1')
  and tr.code in ('AMERICA', 'EUROPE', 'ASIA')
"""


@register("eligible_trades", SQL_ELIGIBLE)
def q_eligible_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw fact as pipe-delimited text -> op 3 read -> lookups (23) -> eligibility (22)."""
    return _ingested_trades(spark, sf_dir)


@register("eligible_outlier_groups", _SQL_SCORED.format(trades=SQL_ELIGIBLE) + """
select trade_date, fund, side, n_accts, total, round(mean, 9) mean, round(std_dev, 9) std_dev,
       round(z, 9) z
from s where z >= 2
""")
def q_eligible_outlier_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 29 end to end from delimited text: ingest, lookups, eligibility, outliers."""
    df = outliers.outlier_groups(_ingested_trades(spark, sf_dir))
    return _round(df, "mean", "std_dev", "z")


@register("account_key_cascade", f"""
with f as ({ad.SQL_RAW_FACT})
select trade_date_key, prdct_acct_key, trade_class_key, {_SQL_CASCADE} acct_key from f
""")
def q_account_key_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ops 11-12 on every raw fact row."""
    from flockwatch.functions.keys import CASCADE_SOURCES, cascade_key
    raw = ad.raw_fact(spark, sf_dir)
    return raw.select("trade_date_key", "prdct_acct_key", "trade_class_key",
                      cascade_key(*CASCADE_SOURCES).alias("acct_key"))


@register("account_key_sources", f"""
with f as ({ad.SQL_RAW_FACT})
select distinct {_SQL_CASCADE} acct_key, {_SQL_SOURCE} source from f
""")
def q_account_key_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 24i: distinct (account key, source column) over the unfiltered fact."""
    return enrich.account_key_sources(ad.raw_fact(spark, sf_dir))


# Customer rows as comma-delimited text exercising the quote-aware reader:
# a quoted field holding the delimiter and escaped quotes, padded fields, and
# an empty last field for customers with a negative balance (such rows have
# the wrong width once the trailing empty field is dropped, D2).
def _customer_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    cu = ad.load(spark, sf_dir, "customer")
    line = F.concat_ws(
        ",",
        F.col("c_custkey").cast("string"),
        F.concat(F.lit('" '), F.col("c_name"), F.lit(', ""'), F.col("c_mktsegment"), F.lit('"" "')),
        F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit(" ")),
        F.when(F.col("c_acctbal") < 0, F.lit("")).otherwise(F.col("c_nationkey").cast("string")))
    return cu.select(line.alias("value"))


_SQL_CUSTOMER_READ = """
select cast(c_custkey as varchar) {id}, c_name || ', ' || c_mktsegment {name},
       c_mktsegment {seg}, cast(c_nationkey as varchar) {nation}
from customer where not (c_acctbal < 0)
"""


@register("delimited_read", _SQL_CUSTOMER_READ.format(id="id", name='"na me"', seg="segment",
                                                       nation="nation"))
def q_delimited_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 1: quote-aware comma reader over text derived from the customer table."""
    path = scratch_path(spark, "customer_text")
    sinks.write_lines(_customer_text(spark, sf_dir), path, header='id,"na me", segment ,nation')
    return delimited.read_delimited(spark, path)


@register("delimited_read_external_header",
          _SQL_CUSTOMER_READ.format(id="cust", name="label", seg="seg", nation="nat"))
def q_delimited_read_external_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 2: names from a separate one-line file; the data's own header is dropped."""
    path = scratch_path(spark, "customer_text")
    sinks.write_lines(_customer_text(spark, sf_dir), path, header="id,name,segment,nation")
    head = scratch_path(spark, "customer_header")
    sinks.write_lines(spark.range(1).select(F.lit('"cust", label ,seg,nat').alias("value")), head,
                      single_file=True)
    return delimited.read_delimited(spark, path, header_path=head)


_LINEITEM_TYPES = [("l_orderkey", "NUMBER(19)"), ("l_partkey", "NUMBER(19)"),
                   ("l_suppkey", "NUMBER(19)"), ("l_linenumber", "NUMBER(10) NOT NULL"),
                   ("l_quantity", "NUMBER(12,2)"), ("l_extendedprice", "NUMBER(12,2)"),
                   ("l_discount", "NUMBER(12,2)"), ("l_tax", "NUMBER(12,2)"),
                   ("l_returnflag", "VARCHAR2(1 CHAR) NOT NULL"), ("l_linestatus", "CHAR(1)"),
                   ("l_shipdate", "DATE")]


@register("catalog_typed_read", """
select cast(l_orderkey as double) l_orderkey, cast(l_partkey as double) l_partkey,
       cast(l_suppkey as double) l_suppkey, cast(l_linenumber as double) l_linenumber,
       l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
       strftime(l_shipdate, '%Y-%m-%d') l_shipdate
from lineitem
""")
def q_catalog_typed_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ops 3-4: lineitem as pipe text, typed by a schema catalogue built from its columns."""
    li = ad.load(spark, sf_dir, "lineitem").withColumn(
        "l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd"))
    path = _write_pipe_text(spark, li, "lineitem_text")
    catalog = spark.createDataFrame(
        [("lineitem", c, i + 1, t) for i, (c, t) in enumerate(_LINEITEM_TYPES)],
        "table_name string, column_name string, column_id int, type_text string")
    raw = delimited.read_fixed_delimited(spark, path, "|")
    return delimited.apply_schema(raw, delimited.struct_type_for(catalog, "lineitem"))


# The customer lines without any header, in a nested folder per segment and sign of the balance.
_SQL_NESTED = """
with t as (select *, c_mktsegment seg, case when c_acctbal < 0 then 'owing' else 'paid' end state,
                  cast(c_custkey as varchar) || ',"' || c_name || '",' || cast(c_nationkey as varchar) as line
           from customer)
"""


def _nested_customers(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """(folder of nested, headerless files; one-line file of names)."""
    cu = ad.load(spark, sf_dir, "customer")
    path, head = scratch_path(spark, "customer_nested"), scratch_path(spark, "customer_names")
    line = F.concat(F.col("c_custkey").cast("string"), F.lit(',"'), "c_name", F.lit('",'), F.col("c_nationkey").cast("string"))
    (cu.select(F.col("c_mktsegment").alias("seg"), F.when(F.col("c_acctbal") < 0, "owing").otherwise("paid").alias("state"),
               line.alias("value")).write.partitionBy("seg", "state").text(path))
    sinks.write_lines(spark.range(1).select(F.lit('cust,"label",nat').alias("value")), head, single_file=True)
    return path, head


def _folder(path: str, level: str):
    return F.regexp_extract(path, f"/{level}=([^/]*)/", 1).alias(level)


@register("headerless_nested_read", _SQL_NESTED + """
select cast(c_custkey as varchar) cust, c_name label, cast(c_nationkey as varchar) nat, seg, state from t
""")
def q_headerless_nested_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ops 2, 6: nested files without headers, names from a second file, each row with its file of origin."""
    path, head = _nested_customers(spark, sf_dir)
    rows = delimited.read_delimited(spark, path, header_path=head, recursive=True, data_has_header=False, file_column="origin")
    return rows.select("cust", "label", "nat", _folder("origin", "seg"), _folder("origin", "state"))


@register("nested_file_listing", _SQL_NESTED + """
select seg, state, cast(sum(strlen(line) + 1) as bigint) n_bytes, count(*) n_rows from t group by seg, state
""")
def q_nested_file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 6: the recursive listing joined with the rows read from each file: bytes and rows per folder."""
    path, head = _nested_customers(spark, sf_dir)
    rows = delimited.read_delimited(spark, path, header_path=head, recursive=True, data_has_header=False, file_column="origin")
    per_file = rows.groupBy(F.regexp_replace("origin", "^file:/+", "/").alias("at")).agg(F.count(F.lit(1)).alias("n"))
    files = (delimited.list_files(spark, path, "part-*").withColumn("at", F.regexp_replace("file_path", "^file:/+", "/"))
             .join(per_file, "at", "left"))
    return (files.groupBy(_folder("at", "seg"), _folder("at", "state"))
            .agg(F.sum("length").alias("n_bytes"), F.sum(F.coalesce("n", F.lit(0))).alias("n_rows")))


_TYPE_TEXT = {"bigint": "NUMBER(19)", "int": "NUMBER(10) NOT NULL", "double": "NUMBER(12,2)", "string": "VARCHAR2(200 CHAR) NOT NULL"}


@register("catalog_file_schemas", """
with c(table_name, column_id, column_name, data_type, nullable) as (values
  ('customer', 1, 'c_custkey', 'double', true), ('customer', 2, 'c_name', 'string', false),
  ('customer', 3, 'c_nationkey', 'double', false), ('customer', 4, 'c_acctbal', 'double', true),
  ('customer', 5, 'c_mktsegment', 'string', false),
  ('supplier', 1, 's_suppkey', 'double', true), ('supplier', 2, 's_name', 'string', false),
  ('supplier', 3, 's_nationkey', 'double', false), ('supplier', 4, 's_acctbal', 'double', true)),
s as (select 'customer' table_name, count(*) n_rows, round(sum(c_acctbal), 2) balance from customer
      union all select 'supplier', count(*), round(sum(s_acctbal), 2) from supplier)
select c.*, n_rows, balance from c join s using (table_name)
""")
def q_catalog_file_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 4: a catalogue file of two tables, grouped per table; both tables are read as text by it, NOT NULL enforced."""
    columns = {"customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
               "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]}
    tables = {t: ad.load(spark, sf_dir, t).select(*cols) for t, cols in columns.items()}
    entries = [f'{t},{c},{i},"{_TYPE_TEXT[dict(df.dtypes)[c]]}"' for t, df in tables.items() for i, c in enumerate(df.columns, 1)]
    path = scratch_path(spark, "catalogue")
    sinks.write_lines(spark.createDataFrame([(x,) for x in reversed(entries)], "value string"), path, header="table,column,id,type")
    catalog = delimited.read_catalog(spark, path)
    read = []
    for t, df in tables.items():
        raw = delimited.read_fixed_delimited(spark, _write_pipe_text(spark, df, f"{t}_text"), "|")
        typed = delimited.apply_schema(raw, delimited.struct_type_for(catalog, t), empty_is_null=True)
        read.append(typed.agg(F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("n_rows"),
                              F.round(F.sum(F.col(f"{t[0]}_acctbal")), 2).alias("balance")))
    fields = delimited.catalog_schemas(catalog).select("table_name", F.explode("fields").alias("f"))
    return (fields.select("table_name", "f.column_id", "f.column_name", "f.data_type", "f.nullable")
            .join(reduce(DataFrame.union, read), "table_name"))


# ---------------------------------------------------------------------------
# Baskets, similarity, target search (ops 30-32, 36-39)
# ---------------------------------------------------------------------------

from flockwatch.operators import baskets as bk  # noqa: E402
from flockwatch.operators import report as rp  # noqa: E402
from flockwatch.operators import runs as rn  # noqa: E402
from flockwatch.operators.ranking import global_positions  # noqa: E402

_ADAPTERS = {"A": (ad.trades_by_supplier_nation, ad.SQL_TRADES_A),
             "A3": (ad.trades_by_segment, ad.SQL_TRADES_A3)}


_WRITTEN: dict = {}


def _data_version(spark: SparkSession, sf_dir: str) -> str:
    """Newest change and total size of the files of the input tables, so that changed data is read anew."""
    tables = [ad.load(spark, sf_dir, t).select("_metadata.file_path", "_metadata.file_modification_time", "_metadata.file_size")
              .distinct() for t in ("lineitem", "orders", "customer", "supplier")]
    row = reduce(DataFrame.union, tables).agg(F.max("file_modification_time"), F.sum("file_size"), F.count(F.lit(1))).first()
    return repr(tuple(row))


def _step_key(spark: SparkSession, sf_dir: str, *more) -> tuple:
    return (spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", ""), sf_dir,
            _data_version(spark, sf_dir), *more)


def _flagged_tables(spark: SparkSession, sf_dir: str, adapter: str) -> tuple[DataFrame, DataFrame]:
    """Flagged trades (op 28) and their basket members, written once per
    session, version of the data files and adapter to the shared folder and
    read back by the later steps, as the reference persists its flagged-trades table (ops 5, 8)."""
    from flockwatch.session import materialize
    key = _step_key(spark, sf_dir, "flagged", adapter)
    if key not in _WRITTEN:
        ft = materialize(outliers.outlier_trades(_ADAPTERS[adapter][0](spark, sf_dir)), "flagged")
        _WRITTEN[key] = (ft, materialize(bk.basket_members(ft), "basket_members"))
    return _WRITTEN[key]


def _flagged_trades(spark: SparkSession, sf_dir: str, adapter: str) -> DataFrame:
    return _flagged_tables(spark, sf_dir, adapter)[0]


def _members(spark: SparkSession, sf_dir: str, adapter: str) -> DataFrame:
    return _flagged_tables(spark, sf_dir, adapter)[1]


def _sql_flagged(adapter: str) -> str:
    """CTEs t, s (scored), ft (flagged trades, distinct) and fl (basket members)."""
    return _SQL_SCORED.format(trades=_ADAPTERS[adapter][1]) + """,
ft as (select distinct s.trade_date, s.fund, s.side, s.n_accts, s.total, s.mean, s.std_dev, s.z,
              t.acct_key, t.share_class_key, t.executing_key, t.clearing_key,
              t.trading_entity_key, t.usd_gross_amt, t.feed_key
       from s join t on s.trade_date = t.trade_date and s.fund = t.fund and s.side = t.side
       where s.z >= 2),
fl as (select distinct trade_date, fund, side, acct_key from ft),
sz as (select trade_date, fund, side, count(*) basket_size from fl group by trade_date, fund, side),
ob as (select *, row_number() over (order by basket_size, trade_date, fund, side) - 1 ord from sz)
"""


@register("baskets", _sql_flagged("A3") + """
select trade_date, fund, side, count(*) basket_size,
       string_agg(acct_key, ',' order by acct_key) members
from fl group by trade_date, fund, side
""")
def q_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 30: one account set per flagged (day, fund, side), adapter A3."""
    sets = bk.basket_sets(_members(spark, sf_dir, "A3"))
    return sets.select(*bk.BASKET_KEYS, "basket_size",
                       F.array_join("accts", ",").alias("members"))


@register("basket_overlap_pairs", _sql_flagged("A3") + """,
m as (select fl.acct_key, ob.* from fl join ob using (trade_date, fund, side)),
p as (select a.ord a, b.ord b, count(*) overlap from m a join m b on a.acct_key = b.acct_key
      where a.ord < b.ord group by a.ord, b.ord)
select a.trade_date a_trade_date, a.fund a_fund, a.side a_side, a.basket_size a_size,
       b.trade_date b_trade_date, b.fund b_fund, b.side b_side, b.basket_size b_size,
       p.overlap, round(p.overlap / least(a.basket_size, b.basket_size), 9) coef
from p join ob a on p.a = a.ord join ob b on p.b = b.ord
where p.overlap / least(a.basket_size, b.basket_size) > 0.8
""")
def q_basket_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 31: basket pairs with overlap coefficient > 0.8 (adapter A3)."""
    return _round(bk.basket_overlap_pairs(_members(spark, sf_dir, "A3")), "coef")


@register("basket_best_match", _sql_flagged("A3") + """,
m as (select fl.acct_key, ob.* from fl join ob using (trade_date, fund, side)),
p as (select a.ord a, b.ord b, count(*) overlap from m a join m b on a.acct_key = b.acct_key
      where a.ord <> b.ord group by a.ord, b.ord),
c as (select p.*, p.overlap / least(x.basket_size, y.basket_size) coef
      from p join ob x on p.a = x.ord join ob y on p.b = y.ord),
rk as (select *, row_number() over (partition by a order by coef desc, b) rn from c where coef > 0)
select x.trade_date, x.fund, x.side, y.trade_date match_trade_date, y.fund match_fund,
       y.side match_side, rk.overlap, round(rk.coef, 9) coef
from rk join ob x on rk.a = x.ord join ob y on rk.b = y.ord where rn = 1
""")
def q_basket_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 32: each basket's best other basket; ties to the lowest order (D6)."""
    return _round(bk.basket_best_match(_members(spark, sf_dir, "A3")), "coef")


def _largest_basket_target(members: DataFrame) -> DataFrame:
    """Op 36 with a data-derived pin: the largest basket (ties by day, fund, side)."""
    top = (bk.basket_sizes(members)
           .orderBy(F.col("basket_size").desc(), *bk.BASKET_KEYS).limit(1).collect())
    if not top:
        return members.limit(0).select("acct_key")
    r = top[0]
    return bk.target_accounts(members, r.trade_date, r.fund, r.side)


def _first_pair_target(members: DataFrame) -> DataFrame:
    """Op 36 with another pin: the first basket of two accounts by day, fund and side."""
    top = (bk.basket_sizes(members).where(F.col("basket_size") == 2).orderBy(*bk.BASKET_KEYS).limit(1).collect())
    if not top:
        return members.limit(0).select("acct_key")
    r = top[0]
    return bk.target_accounts(members, r.trade_date, r.fund, r.side)


_SQL_TARGET = """,
tg as (select trade_date, fund, side from sz
       order by basket_size desc, trade_date, fund, side limit 1),
ta as (select distinct fl.acct_key from fl join tg using (trade_date, fund, side))
"""


_SQL_SMALL_TARGET = """,
tg as (select trade_date, fund, side from sz where basket_size = 2 order by trade_date, fund, side limit 1),
ta as (select distinct fl.acct_key from fl join tg using (trade_date, fund, side))
"""


@register("containment_search", _sql_flagged("A3") + _SQL_SMALL_TARGET + """,
h as (select trade_date, fund, side, count(*) overlap from fl
      where acct_key in (select acct_key from ta) group by trade_date, fund, side)
select h.trade_date, h.fund, h.side, h.overlap, sz.basket_size,
       (select count(*) from ta) t_size
from h join sz using (trade_date, fund, side)
where h.overlap / (select count(*) from ta) > 0.8
""")
def q_containment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 37: baskets holding > 80% of the accounts of the first basket of two (adapter A3)."""
    members = _members(spark, sf_dir, "A3")
    return bk.containment_search(members, _first_pair_target(members))


# Stand-in model family derived from the flagged baskets by plain SQL rules,
# so that the model reports have an SQL oracle: per (fund, side) the accounts
# seen in >= 2 of its baskets (min size 2), per (side, year) those seen in >= 3
# (min size 3).  Every basket is claimed by two models.
def standin_models(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    m1 = (members.groupBy("fund", "side", "acct_key").agg(F.count(F.lit(1)).alias("c"))
                 .filter("c >= 2").drop("c"))
    k1 = global_positions(m1.select("fund", "side").distinct(), ["fund", "side"], "model_id")
    n1 = k1.count()
    fy = members.withColumn("yr", F.year("trade_date"))
    m2 = (fy.groupBy("side", "yr", "acct_key").agg(F.count(F.lit(1)).alias("c"))
            .filter("c >= 3").drop("c"))
    k2 = global_positions(m2.select("side", "yr").distinct(), ["side", "yr"], "model_id") \
        .withColumn("model_id", F.col("model_id") + F.lit(n1))
    mm = (m1.join(k1, ["fund", "side"]).select("model_id", F.lit(2).cast("long").alias("min_size"), "acct_key")
            .unionByName(m2.join(k2, ["side", "yr"])
                         .select("model_id", F.lit(3).cast("long").alias("min_size"), "acct_key")))
    claimed = members.select(*bk.BASKET_KEYS).distinct()
    mt = (claimed.join(k1, ["fund", "side"]).select("model_id", F.lit(2).cast("long").alias("min_size"), *bk.BASKET_KEYS)
              .unionByName(claimed.withColumn("yr", F.year("trade_date")).join(k2, ["side", "yr"])
                           .select("model_id", F.lit(3).cast("long").alias("min_size"), *bk.BASKET_KEYS)))
    return mm, mt


_SQL_MODELS = """,
m1 as (select fund, side, acct_key from fl group by fund, side, acct_key having count(*) >= 2),
k1 as (select fund, side, row_number() over (order by fund, side) - 1 model_id
       from (select distinct fund, side from m1)),
m2 as (select side, year(trade_date) yr, acct_key from fl
       group by side, year(trade_date), acct_key having count(*) >= 3),
k2 as (select side, yr, (select count(*) from k1) + row_number() over (order by side, yr) - 1 model_id
       from (select distinct side, yr from m2)),
mm as (select k1.model_id, cast(2 as bigint) min_size, m1.acct_key from m1 join k1 using (fund, side)
       union all
       select k2.model_id, cast(3 as bigint) min_size, m2.acct_key from m2 join k2 using (side, yr)),
bkeys as (select distinct trade_date, fund, side from fl),
mt as (select k1.model_id, cast(2 as bigint) min_size, b.trade_date, b.fund, b.side
       from bkeys b join k1 using (fund, side)
       union all
       select k2.model_id, cast(3 as bigint) min_size, b.trade_date, b.fund, b.side
       from bkeys b join k2 on b.side = k2.side and year(b.trade_date) = k2.yr)
"""


@register("target_vs_sets", _sql_flagged("A3") + _SQL_TARGET + _SQL_MODELS + """,
msz as (select model_id, min_size, count(distinct acct_key) model_size from mm group by all),
h as (select model_id, min_size, count(distinct acct_key) overlap from mm
      where acct_key in (select acct_key from ta) group by all)
select h.model_id, h.min_size, round(h.overlap / msz.model_size, 9) model_ratio, h.overlap
from h join msz using (model_id, min_size) where h.overlap >= h.min_size
""")
def q_target_vs_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 38: models overlapping the target by at least their min size (adapter A3)."""
    members = _members(spark, sf_dir, "A3")
    mm, _ = standin_models(members)
    return _round(bk.target_vs_sets(mm, _largest_basket_target(members)), "model_ratio")


@register("target_coverage", _sql_flagged("A") + """,
tg as (select trade_date, fund, side from sz
       order by basket_size desc, trade_date, fund, side limit 1),
ta as (select distinct fl.acct_key from fl join tg using (trade_date, fund, side))
""" + _SQL_MODELS + """,
c as (select count(*) target_size,
             count(*) filter (where acct_key not in (select acct_key from mm)) uncovered from ta)
select uncovered, target_size,
       case when target_size > 0 then 100.0 * uncovered / target_size end pct_uncovered,
       case when target_size > 0 then cast(cast(100.0 * uncovered / target_size as double) as varchar) || '%' end pct_text
from c
""")
def q_target_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 39: share of the target's accounts in no model (adapter A)."""
    members = _members(spark, sf_dir, "A")
    mm, _ = standin_models(members)
    return bk.target_coverage(mm, _largest_basket_target(members))


# ---------------------------------------------------------------------------
# Reports and runs (ops 41-44) over the stand-in models
# ---------------------------------------------------------------------------

def _sql_report(keys: str) -> str:
    return _sql_flagged("A3") + _SQL_MODELS + f""",
ag as (select {keys}, cast(count(distinct acct_key) as double) n_accts,
              sum(usd_gross_amt) sum_usd from ft group by {keys})
select distinct mt.model_id, mt.min_size, {', '.join('ag.' + k.strip() for k in keys.split(','))},
       ag.n_accts, round(ag.sum_usd, 2) sum_usd
from ag join mt on ag.trade_date = mt.trade_date and ag.fund = mt.fund and ag.side = mt.side
"""


@register("trade_analysis_firm",
          _sql_report("trade_date, fund, side, executing_key, clearing_key"))
def q_trade_analysis_firm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 42: accounts and USD per model trade and (executing, clearing) firm."""
    ft = _flagged_trades(spark, sf_dir, "A3")
    _, mt = standin_models(bk.basket_members(ft))
    df = rp.trade_analysis_firm(ft, mt)
    return df.withColumn("sum_usd", F.round("sum_usd", 2))


@register("trade_analysis_entity", _sql_report("trade_date, fund, side, trading_entity_key"))
def q_trade_analysis_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 43: accounts and USD per model trade and trading entity."""
    ft = _flagged_trades(spark, sf_dir, "A3")
    _, mt = standin_models(bk.basket_members(ft))
    df = rp.trade_analysis_entity(ft, mt)
    return df.withColumn("sum_usd", F.round("sum_usd", 2))


_SQL_RUNS = """,
ev0 as (select distinct model_id, trade_date, fund, side from mt),
ev as (select *, row_number() over (partition by model_id order by trade_date, fund, side) - 1 idx,
              count(*) over (partition by model_id) n from ev0),
mm2 as (select distinct model_id, acct_key from mm),
tr as (select ev.model_id, fl.acct_key, ev.idx, ev.trade_date, ev.n
       from ev join fl on ev.trade_date = fl.trade_date and ev.fund = fl.fund and ev.side = fl.side
       join mm2 on mm2.model_id = ev.model_id and mm2.acct_key = fl.acct_key),
isl as (select *, idx - row_number() over (partition by model_id, acct_key order by idx) grp from tr),
ru as (select model_id, acct_key, min(idx) fi, max(idx) li, count(*) len,
             arg_min(trade_date, idx) first_date, arg_max(trade_date, idx) last_date,
             any_value(n) n
      from isl group by model_id, acct_key, grp)
select model_id, acct_key, first_date, last_date, len run_length,
       cast(li = n - 2 as integer) last_flag
from ru where li < n - 1 and (len > 1 or li = n - 2)
"""


@register("participation_runs", _sql_flagged("A3") + _SQL_MODELS + _SQL_RUNS)
def q_participation_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 44: runs of consecutive model trades per member (faithful formula)."""
    members = _members(spark, sf_dir, "A3")
    mm, mt = standin_models(members)
    return rn.participation_runs(members, mm, mt)


# ---------------------------------------------------------------------------
# Mining (ops 33-35), export round trip (ops 7-10, 24d), itemsets (op 40)
# ---------------------------------------------------------------------------

from flockwatch.operators import itemsets as fi  # noqa: E402
from flockwatch.operators import mining as mn  # noqa: E402

# Scale-appropriate parameters for the test data: baskets here hold a handful
# of accounts, so the reference's minimum sizes (50, 100, 200) would find
# nothing; sizes 2, 3, 4 and two passes are the settings of FIXTURES.md.
MINING_SIZES = (2, 3, 4)
MINING_PASSES = 2


def _mined(spark: SparkSession, sf_dir: str, adapter: str = "A") -> mn.MiningResult:
    """Mine once per session, data and adapter; later queries read the written
    model tables back, as the reference's reports read its model files."""
    key = _step_key(spark, sf_dir, "mined", adapter, MINING_SIZES, MINING_PASSES)
    if key not in _WRITTEN:
        res = mn.recurring_sets(_members(spark, sf_dir, adapter), MINING_SIZES, MINING_PASSES)
        _WRITTEN[key] = mn.MiningResult(members=materialize(res.members, "model_members"),
                                        trades=materialize(res.trades, "model_trades"),
                                        sets=materialize(res.sets, "model_sets"),
                                        rounds=res.rounds)
    return _WRITTEN[key]


def _sql_score(models: str, accounts: str) -> str:
    """Overlap coefficient of every model of a list with an account list."""
    return (f"list_transform({models}, lambda m: case when len({accounts}) = 0 then 0.0 else "
            f"len(list_intersect(m.acc, {accounts})) / least(len(m.acc), len({accounts})) end)")


# Rules R1-R6 one basket at a time: the state of a minimum size is the list of its models, oldest
# first; every step of the recursion reads the next basket.  ``born`` orders versions: found, basket
# rest, set rest, then the shrunk version of the same step.
_SQL_MINED = _sql_flagged("A").replace("with t as", "with recursive t as", 1) + """,
bb as (select ord, list(acct_key order by acct_key) b from fl join ob using (trade_date, fund, side) group by ord),
nb as (select count(*) n from bb),
st(ms, step, models) as (
  select unnest({sizes}), cast(0 as bigint), cast([] as struct(acc varchar[], occ bigint[], born bigint)[])
  union all
  select ms, step + 1, case when not offer_m then m2 when r4 > 0.8 then
           list_transform(m2, lambda m, i: case when i = at4 then
             struct_pack(acc := m.acc, occ := list_distinct(list_append(m.occ, ord)), born := m.born) else m end)
         else list_append(m2, struct_pack(acc := q, occ := [ord], born := step * 4 + 2)) end
  from (select *, coalesce(list_max(s4), 0) r4, list_position(s4, list_max(s4)) at4
  from (select *, {score_q} s4
  from (select *, case when not offer_b then m1 when r3 > 0.8 then
           list_transform(m1, lambda m, i: case when i = at3 then
             struct_pack(acc := m.acc, occ := list_distinct(list_append(m.occ, ord)), born := m.born) else m end)
         else list_append(m1, struct_pack(acc := p, occ := [ord], born := step * 4 + 1)) end m2
  from (select *, coalesce(list_max(s3), 0) r3, list_position(s3, list_max(s3)) at3
  from (select *, {score_p} s3
  from (select *, case
           when r <= 0.2 then case when len(b) >= ms then list_append(m0, struct_pack(acc := b, occ := [ord], born := step * 4)) else m0 end
           when r > 0.8 and len(q) >= ms and len(both_) > ms then
             list_transform(m0, lambda m, i: case when i = at0 then struct_pack(acc := both_, occ := [ord], born := step * 4 + 3) else m end)
           when r > 0.8 and len(q) < ms then
             list_transform(m0, lambda m, i: case when i = at0 then
               struct_pack(acc := m.acc, occ := list_distinct(list_append(m.occ, ord)), born := m.born) else m end)
           else m0 end m1,
         r > 0.2 and len(p) >= ms offer_b, r > 0.8 and len(q) >= ms offer_m
  from (select *, list_filter(b, lambda x: not list_contains(known, x)) p,
         list_filter(known, lambda x: not list_contains(b, x)) q,
         list_filter(b, lambda x: list_contains(known, x)) both_
  from (select *, case when r > 0.2 then m0[at0].acc else [] end known
  from (select *, coalesce(list_max(s), 0) r, list_position(s, list_max(s)) at0
  from (select *, {score_b} s
  from (select ms, step, ord, b, case when ord = 0
             then list_transform(models, lambda m: struct_pack(acc := m.acc, occ := cast([] as bigint[]), born := m.born)) else models end m0
        from st join bb on bb.ord = step % (select n from nb)
        where step < {passes} * (select n from nb))))))))))))),
last as (select ms, models from st where step = {passes} * (select n from nb)),
md as (select row_number() over (order by ms, m.born, i) - 1 model_id, cast(ms as bigint) min_size, m.acc, m.occ, len(m.acc) set_size,
              len(m.occ) n_baskets, len(m.occ) > 1 repeated
       from (select ms, unnest(models) m, unnest(range(1, len(models) + 1)) i from last))
"""


def _sql_mined() -> str:
    return _SQL_MINED.format(sizes=list(MINING_SIZES), passes=MINING_PASSES, score_b=_sql_score("m0", "b"),
                             score_p=_sql_score("m1", "p"), score_q=_sql_score("m2", "q"))


SQL_MINED = _sql_mined()
_SQL_MINED_MODELS = SQL_MINED + """,
mm as (select model_id, min_size, unnest(acc) acct_key from md where repeated),
mt as (select model_id, min_size, trade_date, fund, side
       from (select model_id, min_size, unnest(occ) ord from md where repeated) join ob using (ord))
"""


@register("recurring_sets", _SQL_MINED_MODELS + "select model_id, min_size, acct_key from mm")
def q_recurring_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ops 33-35: members of repeated sets (adapter A)."""
    return _mined(spark, sf_dir).members


@register("recurring_set_trades", _SQL_MINED_MODELS + "select * from mt")
def q_recurring_set_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ops 33-35: the baskets credited to each repeated set (adapter A)."""
    return _mined(spark, sf_dir).trades


@register("recurring_set_summary", SQL_MINED + "select model_id, min_size, set_size, n_baskets, repeated from md")
def q_recurring_set_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every current set with its size and number of distinct baskets."""
    return _mined(spark, sf_dir).sets


@register("sets_union_export", _SQL_MINED_MODELS + """
select mt.*, array_to_string(list_sort(acc), ',') members from mt join md using (model_id, min_size)
""")
def q_sets_union_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ops 7-10, 24d: per-size outputs unioned, exported as headerless CSV and
    read back as member sets joined to their trades."""
    res = _mined(spark, sf_dir)
    pm, pt = scratch_path(spark, "model_members"), scratch_path(spark, "model_trades")
    sinks.export_models(res.members, res.trades, pm, pt)
    sets = delimited.model_member_sets(delimited.read_model_members(spark, pm))
    trades = delimited.read_model_trades(spark, pt)
    return trades.join(sets, ["model_id", "min_size"]).select(
        "model_id", "min_size", "trade_date", "fund", "side",
        F.array_join("accts", ",").alias("members"))


@register("mined_trade_analysis_firm", _SQL_MINED_MODELS + """,
ag as (select trade_date, fund, side, executing_key, clearing_key,
              cast(count(distinct acct_key) as double) n_accts, sum(usd_gross_amt) sum_usd
       from ft group by all)
select distinct mt.model_id, mt.min_size, ag.trade_date, ag.fund, ag.side, ag.executing_key, ag.clearing_key,
       ag.n_accts, round(ag.sum_usd, 2) sum_usd
from ag join mt on ag.trade_date = mt.trade_date and ag.fund = mt.fund and ag.side = mt.side
""")
def q_mined_trade_analysis_firm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 42 over the mined sets (adapter A), end to end."""
    ft = _flagged_trades(spark, sf_dir, "A")
    return rp.trade_analysis_firm(ft, _mined(spark, sf_dir).trades).withColumn("sum_usd", F.round("sum_usd", 2))


@register("mined_participation_runs", _SQL_MINED_MODELS + _SQL_RUNS)
def q_mined_participation_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 44 over the mined sets (adapter A), end to end."""
    members = _members(spark, sf_dir, "A")
    res = _mined(spark, sf_dir)
    return rn.participation_runs(members, res.members, res.trades)


# All sizes: a frequent set grows by an account that sorts after its last one.
_SQL_ITEMS = _sql_flagged("A3").replace("with t as", "with recursive t as", 1) + """,
need as (select ceil({support} * count(*)) n from sz),
bb as (select list(acct_key order by acct_key) accts from fl group by trade_date, fund, side),
f as (select [acct_key] items, count(*) freq from fl group by acct_key having count(*) >= (select n from need)
      union all
      select list_append(items, x) items, count(*) freq
      from (select items, unnest(list_filter(accts, lambda a: a > items[-1])) x
            from f join bb on list_has_all(accts, items))
      group by items, x having count(*) >= (select n from need))
select array_to_string(items, ',') items, cast(len(items) as integer) itemset_size, freq from f
"""


def _itemsets(spark: SparkSession, sf_dir: str, support: float) -> DataFrame:
    df = fi.frequent_itemsets(_members(spark, sf_dir, "A3"), min_support=support, num_partitions=None)
    return df.select(F.array_join("items", ",").alias("items"),
                     F.col("itemset_size").cast("int").alias("itemset_size"), "freq")


@register("frequent_itemsets", _SQL_ITEMS.format(support=0.1))
def q_frequent_itemsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 40: FP-growth at support 0.1 over the flagged baskets (adapter A3), all sizes."""
    return _itemsets(spark, sf_dir, 0.1)


@register("frequent_itemsets_all", _SQL_ITEMS.format(support=0.005))
def q_frequent_itemsets_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 40 at support 0.005, where sets of one to several accounts are frequent."""
    return _itemsets(spark, sf_dir, 0.005)


@register("flagged_preview", _SQL_SCORED.format(trades=ad.SQL_TRADES_A) + """
select trade_date, fund, side, n_accts, total, round(mean, 9) mean, round(std_dev, 9) std_dev,
       round(z, 9) z
from s where z >= 2
order by n_accts desc, trade_date, fund, side limit 20
""")
def q_flagged_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ops 24h, 24j: top 20 flagged groups by activity (adapter A)."""
    df = outliers.flagged_preview(outliers.outlier_groups(ad.trades_by_supplier_nation(spark, sf_dir)))
    return _round(df, "mean", "std_dev", "z")


# ---------------------------------------------------------------------------
# Periods, the pipeline to its end, and smaller operators in whole-table queries
# ---------------------------------------------------------------------------

PERIOD = ("1993-06-01", "1996-06-01")     # inside the dates of the data; the end is exclusive
_SQL_PERIOD_TRADES = f"""select * from ({ad.SQL_TRADES_A})
where trade_date >= date '{PERIOD[0]}' and trade_date < date '{PERIOD[1]}'"""


@register("outlier_groups_period", _SQL_SCORED.format(trades=_SQL_PERIOD_TRADES) + """
select trade_date, fund, side, n_accts, total, round(mean, 9) mean, round(std_dev, 9) std_dev,
       round(z, 9) z
from s where z >= 2
""")
def q_outlier_groups_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 25 with ops 26-27: flagged groups of a period (adapter A)."""
    df = outliers.outlier_groups(ad.trades_by_supplier_nation(spark, sf_dir), *PERIOD)
    return _round(df, "mean", "std_dev", "z")


@register("outlier_pipeline", _SQL_SCORED.format(trades=_SQL_PERIOD_TRADES) + f"""
select distinct s.trade_date, s.fund, s.side, s.n_accts, s.total, round(s.mean, 9) mean,
       round(s.std_dev, 9) std_dev, round(s.z, 9) z, t.acct_key, t.share_class_key,
       t.executing_key, t.clearing_key, t.trading_entity_key, t.usd_gross_amt, t.feed_key
from s join ({ad.SQL_TRADES_A}) t on s.trade_date = t.trade_date and s.fund = t.fund and s.side = t.side
where s.z >= 2
""")
def q_outlier_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 29 to its end: period, flags, trade detail, table written and read back (ops 5, 8, 25-28)."""
    trades = outliers.outlier_trades(ad.trades_by_supplier_nation(spark, sf_dir), *PERIOD)
    path = scratch_path(spark, "outlier_pipeline")
    sinks.write_table(_round(trades, "mean", "std_dev", "z"), path)
    return sinks.read_table(spark, path)


@register("model_file_round_trip", _sql_flagged("A3") + _SQL_MODELS + """,
ms as (select model_id, min_size, string_agg(distinct acct_key, ',' order by acct_key) members from mm group by all)
select mt.model_id, mt.min_size, mt.trade_date, mt.fund, mt.side, ms.members
from (select distinct * from mt) mt join ms using (model_id, min_size)
""")
def q_model_file_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ops 7, 9, 10: model files written as text and read back (stand-in models, adapter A3)."""
    mm, mt = standin_models(_members(spark, sf_dir, "A3"))
    pm, pt = scratch_path(spark, "model_members"), scratch_path(spark, "model_trades")
    sinks.export_models(mm, mt, pm, pt)
    sets = delimited.model_member_sets(delimited.read_model_members(spark, pm))
    return (delimited.read_model_trades(spark, pt).distinct().join(sets, ["model_id", "min_size"])
            .select("model_id", "min_size", *bk.BASKET_KEYS, F.array_join("accts", ",").alias("members")))


@register("normalised_trades", _sql_flagged("A3") + """
select distinct strftime(trade_date, '%Y%m%d') trade_date_text, fund || '|' || side packed_key, fund, side, acct_key
from ft
""")
def q_normalised_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ops 14, 15, 41: normalised flagged trades; the packed key is built and split again (adapter A3)."""
    df = rp.normalise_for_matching(_flagged_trades(spark, sf_dir, "A3"))
    df = df.withColumn("packed_key", keys.fund_side_key("fund", "side", "|"))
    fund, side = keys.split_fund_side("packed_key", "|")
    return df.select("trade_date_text", "packed_key", fund.alias("fund"), side.alias("side"), "acct_key").distinct()


@register("baskets_meeting_target", _sql_flagged("A3") + _SQL_SMALL_TARGET + """
select distinct trade_date, fund, side from fl where acct_key in (select acct_key from ta)
""")
def q_baskets_meeting_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 24b: baskets that hold any account of a target, by a semi join (adapter A3)."""
    members = _members(spark, sf_dir, "A3")
    return (members.join(_first_pair_target(members), "acct_key", "left_semi")
            .select(*bk.BASKET_KEYS).distinct())


@register("basket_set_algebra", _sql_flagged("A3") + _SQL_SMALL_TARGET + """,
b as (select trade_date, fund, side, list(acct_key order by acct_key) a from fl group by trade_date, fund, side),
l as (select coalesce(list(acct_key order by acct_key), []) t from ta)
select trade_date, fund, side, array_to_string(list_sort(list_intersect(a, t)), ',') common,
       array_to_string(list_filter(a, lambda x: not list_contains(t, x)), ',') rest,
       case when len(t) = 0 then 0.0 else round(len(list_intersect(a, t)) / least(len(a), len(t)), 9) end coef
from b, l
""")
def q_basket_set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 20: every basket against a target by array algebra (adapter A3)."""
    from flockwatch.functions import sets as fs
    members = _members(spark, sf_dir, "A3")
    # One row: the target's accounts.
    target = [r.acct_key for r in _first_pair_target(members).orderBy("acct_key").collect()]
    t = F.array(*[F.lit(x) for x in target]) if target else F.array().cast("array<string>")
    return bk.basket_sets(members).select(
        *bk.BASKET_KEYS, F.array_join(F.array_sort(fs.set_intersection("accts", t)), ",").alias("common"),
        F.array_join(F.array_sort(fs.set_difference("accts", t)), ",").alias("rest"),
        F.round(fs.overlap_coefficient("accts", t), ROUND).alias("coef"))


@register("participation_runs_open", ORACLE_SQL["participation_runs"].replace(
    "cast(li = n - 2 as integer)", "cast(li = n - 1 as integer)").replace(
    "where li < n - 1 and (len > 1 or li = n - 2)", "where li = n - 1 or len > 1"))
def q_participation_runs_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 44 with runs that are still open at the last event (D9)."""
    members = _members(spark, sf_dir, "A3")
    mm, mt = standin_models(members)
    return rn.participation_runs(members, mm, mt, include_open=True)


@register("report_text_lines", ORACLE_SQL["trade_analysis_entity"].replace(
    "select distinct mt.model_id", "select distinct concat_ws(',', mt.model_id").replace(
    "round(ag.sum_usd, 2) sum_usd", "printf('%.2f', round(ag.sum_usd, 2))) as line").replace(
    "ag.n_accts,", "printf('%.1f', ag.n_accts),"))
def q_report_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ops 7, 43: the entity report as text lines (stand-in models, adapter A3)."""
    ft = _flagged_trades(spark, sf_dir, "A3")
    _, mt = standin_models(bk.basket_members(ft))
    return rp.as_text_lines(rp.trade_analysis_entity(ft, mt)).select(F.col("value").alias("line"))
