"""Sinks (ops 5, 7, 8) and the model export round trip (ops 9, 10, 35)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Op 8: overwrite a Parquet table."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Op 5: load a persisted Parquet table."""
    return spark.read.parquet(path)


def write_lines(lines: DataFrame, path: str, header: str | None = None,
                single_file: bool = False) -> None:
    """Op 7: overwrite a text output of pre-formatted lines (column ``value``).

    Written through the CSV writer with quoting off and a separator that never
    occurs, so each line is emitted as is.  With ``header`` every part file
    starts with that line, so each file reads on its own.  ``single_file``
    coalesces to one task and is meant only for small exports.
    """
    df = lines.select(F.col(lines.columns[0]).alias(header or "value"))
    if single_file:
        df = df.coalesce(1)
    (df.write.mode("overwrite")
       .option("sep", "\u0001").option("quote", "").option("escape", "")
       .option("header", "true" if header is not None else "false")
       .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
       .csv(path))


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Op 7: headerless comma-separated export of typed columns."""
    if single_file:
        df = df.coalesce(1)
    df.write.mode("overwrite").option("header", "false").csv(path)


def export_models(members: DataFrame, model_trades: DataFrame, path_members: str,
                  path_trades: str) -> None:
    """Op 35 export: ``id,min_size,acct`` and ``id,min_size,yyyyMMdd,fund,side`` lines."""
    write_csv(members.select("model_id", "min_size", "acct_key"), path_members)
    write_csv(model_trades.select("model_id", "min_size",
                                  F.date_format("trade_date", "yyyyMMdd").alias("d"),
                                  "fund", "side"), path_trades)
