"""Delimited text readers, the schema catalogue and file listing (ops 1-4, 6, 9, 10).

Lines are read with ``spark.read.text`` and split by a Java regex with the
built-in ``split``; nothing runs in Python per row.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value that must equal the reference's: the default delimiter, a comma
# followed by an even number of double quotes up to the end of the line:
#   ,(?=([^"]*"[^"]*")*[^"]*$)
QUOTE_AWARE_COMMA = ',(?=([^"]*"[^"]*")*[^"]*$)'

# Characters Java's String.trim removes: every code point up to U+0020.
_JAVA_TRIM = r"^[\x00-\x20]+|[\x00-\x20]+$"


def _clean_field(c, strip_quotes: bool, trim: bool):
    if strip_quotes:
        c = F.regexp_replace(c, '"', "")
    if trim:
        c = F.regexp_replace(c, _JAVA_TRIM, "")
    return c


def _split_names(line: str, delim_regex: str, strip_quotes: bool, trim: bool) -> list[str]:
    # The header is one line already on the driver; Python's re handles the
    # default delimiter the same way Java does.
    parts = re.split(delim_regex.replace("(?=(", "(?=(?:"), line)
    while parts and parts[-1] == "":
        parts.pop()
    out = []
    for p in parts:
        if strip_quotes:
            p = p.replace('"', "")
        if trim:
            p = re.sub(_JAVA_TRIM, "", p)
        out.append(p)
    return out


def _first_line(spark: SparkSession, path: str) -> str:
    row = spark.read.text(path).first()
    if row is None:
        raise ValueError(f"no lines in {path}")
    return row.value


def split_lines(lines: DataFrame, names: list[str], delim_regex: str, header_line: str | None,
                strip_quotes: bool = True, trim: bool = True,
                keep_trailing_empty: bool = False, file_column: str | None = None) -> DataFrame:
    """Split a ``value`` column of lines into string columns called ``names``.

    Lines equal to ``header_line`` are dropped (for streams, which know no first
    line).  ``file_column`` takes the lines' ``file_path`` along under that name.  By default trailing empty fields are dropped before the width
    check, as Java's ``split`` does (D2): a row whose last field is empty has the
    wrong width, a row with surplus empty trailing fields fits.  Rows of another
    width are dropped.
    """
    raw = F.col("value")
    if header_line is not None:
        lines = lines.filter(raw != F.lit(header_line))
    v = raw
    if not keep_trailing_empty:
        v = F.regexp_replace(raw, f"(?:{delim_regex})+$", "")
    arr = F.split(v, delim_regex, -1)
    width = F.size(arr)
    if not keep_trailing_empty:
        # A line of delimiters only has no fields at all once trailing empty
        # fields are dropped (an empty line still has one).
        width = F.when((v == "") & (raw != ""), F.lit(0)).otherwise(width)
    n = len(names)
    origin = [F.col("file_path").alias("_p")] if file_column else []
    parts = lines.select(arr.alias("_f"), width.alias("_w"), *origin).filter(F.col("_w") == n)
    return parts.select(*[_clean_field(F.col("_f")[i], strip_quotes, trim).alias(name)
                          for i, name in enumerate(names)],
                        *([F.col("_p").alias(file_column)] if file_column else []))


def drop_first_lines(lines: DataFrame) -> DataFrame:
    """``lines`` (value, file_path, file_block_start) without the first line of every file.

    The first line of a file is the first row of the split that starts at byte
    0, whatever it says: a data row that equals the header stays.  One row
    number per file is gathered and taken out again by an anti join; the
    numbers are broadcast, so that the lines are not shuffled.
    """
    numbered = lines.withColumn("_row", F.monotonically_increasing_id())
    first = (numbered.groupBy("file_path").agg(F.min(F.when(F.col("file_block_start") == 0, F.col("_row"))).alias("_row"))
             .select("_row"))
    return numbered.join(F.broadcast(first), "_row", "left_anti").drop("_row", "file_block_start")


def _data_lines(spark: SparkSession, path: str, has_header: bool, recursive: bool = False,
                glob: str | None = None) -> tuple[DataFrame, str]:
    """(lines without the header line of each file, the first line of all)."""
    reader = spark.read
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    text = reader.text(path)
    first = text.first()
    if first is None:
        raise ValueError(f"no lines in {path}")
    lines = text.select("value", "_metadata.file_path", "_metadata.file_block_start")
    return (drop_first_lines(lines) if has_header else lines.drop("file_block_start")), first.value


def read_delimited(spark: SparkSession, path: str, delim_regex: str = QUOTE_AWARE_COMMA,
                   header_path: str | None = None, strip_quotes: bool = True, trim: bool = True,
                   keep_trailing_empty: bool = False, recursive: bool = False,
                   glob: str | None = None, data_has_header: bool = True,
                   file_column: str | None = None) -> DataFrame:
    """Ops 1-2: all-string DataFrame from delimited text with a header line per file.

    Column names come from the first line of ``header_path`` when given (op 2),
    else of ``path``.  The first line of every data file is dropped, and no
    other line; ``data_has_header=False`` (with a ``header_path``) keeps it.
    ``file_column`` adds the path of the file that each row comes from (op 6).
    """
    if not data_has_header and not header_path:
        raise ValueError("data without a header needs header_path")
    lines, first = _data_lines(spark, path, data_has_header, recursive, glob)
    name_line = _first_line(spark, header_path) if header_path else first
    names = _split_names(name_line, delim_regex, strip_quotes, trim)
    return split_lines(lines, names, delim_regex, None, strip_quotes, trim, keep_trailing_empty, file_column)


def read_fixed_delimited(spark: SparkSession, path: str, delimiter: str = "|",
                         keep_trailing_empty: bool = False) -> DataFrame:
    """Op 3: single-character delimiter, no quote handling and no trimming."""
    delim_regex = re.escape(delimiter)
    lines, first = _data_lines(spark, path, True)
    names = _split_names(first, delim_regex, False, False)
    return split_lines(lines, names, delim_regex, None, False, False, keep_trailing_empty)


# ---------------------------------------------------------------------------
# Schema catalogue (op 4)
# ---------------------------------------------------------------------------

def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue file: lines of table, column, column id and type text, with a header; quotes guard commas."""
    rows = read_delimited(spark, path)
    if len(rows.columns) != 4:
        raise ValueError(f"{path}: a catalogue has 4 columns, not {len(rows.columns)}")
    return rows.toDF("table_name", "column_name", "column_id", "type_text")


def catalog_types(catalog: DataFrame) -> DataFrame:
    """Rows (table_name, column_name, column_id, type_text) -> typed fields.

    Type rule on the first word of the type text, tested in this order:
    contains CHAR -> string, TIMESTAMP -> timestamp, NUMBER -> double, else
    string.  Nullable unless the text ends with NOT NULL.
    """
    first = F.split(F.col("type_text"), " ")[0]
    dtype = (F.when(first.contains("CHAR"), F.lit("string"))
              .when(first.contains("TIMESTAMP"), F.lit("timestamp"))
              .when(first.contains("NUMBER"), F.lit("double"))
              .otherwise(F.lit("string")))
    return catalog.select(
        "table_name", "column_name",
        F.col("column_id").cast("int").alias("column_id"),
        dtype.alias("data_type"),
        (~F.col("type_text").endswith("NOT NULL")).alias("nullable"))


def catalog_schemas(catalog: DataFrame) -> DataFrame:
    """One row per table: its fields ordered by column id (intended reading, D12)."""
    typed = catalog_types(catalog)
    field = F.struct("column_id", "column_name", "data_type", "nullable")
    return typed.groupBy("table_name").agg(F.sort_array(F.collect_list(field)).alias("fields"))


def struct_type_for(catalog: DataFrame, table: str) -> T.StructType:
    """The StructType of one table (a schema: a handful of rows on the driver)."""
    rows = (catalog_types(catalog).filter(F.col("table_name") == table)
            .orderBy("column_id").collect())
    names = {"string": T.StringType(), "timestamp": T.TimestampType(), "double": T.DoubleType()}
    return T.StructType([T.StructField(r.column_name, names[r.data_type], r.nullable) for r in rows])


_NEVER_USED = {"string": "", "double": 0.0, "timestamp": dt.datetime(1970, 1, 1)}


def apply_schema(df: DataFrame, schema: T.StructType, empty_is_null: bool = False) -> DataFrame:
    """Cast all-string columns to the catalogue's types (strict casts).

    A NOT NULL column carries a guard in the plan: a null there fails the job.
    ``empty_is_null`` reads empty fields as nulls.
    """
    def typed(f: T.StructField):
        raw = F.nullif(F.col(f.name), F.lit("")) if empty_is_null else F.col(f.name)
        col = raw.cast(f.dataType)
        if not f.nullable:
            col = F.when(col.isNull(), F.raise_error(F.lit(f"null in NOT NULL column {f.name}")).cast(f.dataType)).otherwise(col)
            # The value is never used; it tells the planner that no null gets here.
            col = F.coalesce(col, F.lit(_NEVER_USED[f.dataType.typeName()]))
        return col.alias(f.name)

    return df.select(*[typed(f) for f in schema.fields])


# ---------------------------------------------------------------------------
# File listing (op 6) and model read-back (ops 9, 10)
# ---------------------------------------------------------------------------

def list_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """All files below ``path`` (recursively), optionally filtered by a glob.

    Uses the binary-file source with only the path column selected, so file
    contents are not read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(F.col("path").alias("file_path"), "length")


MEMBERS_SCHEMA = "model_id long, min_size long, acct_key string"
MODEL_TRADES_SCHEMA = "model_id long, min_size long, trade_date_text string, fund string, side string"


def read_model_members(spark: SparkSession, path: str) -> DataFrame:
    """Op 9: headerless ``id,min_size,acct`` lines -> long table."""
    return spark.read.schema(MEMBERS_SCHEMA).csv(path)


def model_member_sets(members: DataFrame) -> DataFrame:
    """Op 9 (set view): (model_id, min_size, accounts array)."""
    return members.groupBy("model_id", "min_size").agg(
        F.array_sort(F.collect_set("acct_key")).alias("accts"))


def read_model_trades(spark: SparkSession, path: str) -> DataFrame:
    """Op 10: headerless ``id,min_size,date,fund,side`` lines; dashes removed from the date."""
    df = spark.read.schema(MODEL_TRADES_SCHEMA).csv(path)
    return df.select("model_id", "min_size",
                     F.to_date(F.regexp_replace("trade_date_text", "-", ""), "yyyyMMdd").alias("trade_date"),
                     "fund", "side")
