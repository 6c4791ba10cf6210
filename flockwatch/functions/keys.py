"""Key cleaning and key building (ops 11-17)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for right results:
#   the key used when no account identifier is present: INVALID_KEY
#   the values that mean "absent" in an account-id column: "", "-998", "-999"
#   the delimiter between fund and side in exported composite keys: _@_
#   the source labels of the cascade, in cascade order:
#     bin_number, ext_acct_key, rep_alias_key, client_acct_key; none found: ERROR
INVALID_KEY = "INVALID_KEY"
SENTINELS = ("", "-998", "-999")
TRADE_DELIM = "_@_"
CASCADE_SOURCES = ("bin_number", "ext_acct_key", "rep_alias_key", "client_acct_key")
NO_SOURCE = "ERROR"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sentinel_to_null(c, sentinels=SENTINELS) -> Column:
    """Op 11: the absent markers become NULL; NULL stays NULL."""
    c = _col(c)
    return F.when(~c.isin(*sentinels), c)


def cascade_key(*cols, invalid: str = INVALID_KEY, clean: bool = True) -> Column:
    """Op 12: first present identifier, else the invalid key."""
    parts = [sentinel_to_null(c) if clean else _col(c) for c in cols]
    return F.coalesce(*parts, F.lit(invalid))


def labelled_cascade(named_cols: dict | None = None, invalid: str = INVALID_KEY,
                     none_label: str = NO_SOURCE, clean: bool = True) -> Column:
    """Op 13: struct(acct_key, source) naming the column the key came from.

    ``named_cols`` maps a source label to its column, in cascade order; by default
    the four raw identifier columns under their own names.
    """
    if named_cols is None:
        named_cols = {name: name for name in CASCADE_SOURCES}
    branches = []
    for label, c in named_cols.items():
        v = sentinel_to_null(c) if clean else _col(c)
        branches.append(F.when(v.isNotNull(), F.struct(v.alias("acct_key"), F.lit(label).alias("source"))))
    fallback = F.struct(F.lit(invalid).alias("acct_key"), F.lit(none_label).alias("source"))
    return F.coalesce(*branches, fallback)


def fund_side_key(fund, side, delim: str = TRADE_DELIM) -> Column:
    """Op 14: composite text key, used only in exported output."""
    return F.concat_ws(delim, _col(fund), _col(side))


def split_fund_side(key, delim: str = TRADE_DELIM) -> tuple[Column, Column]:
    """Op 15: the composite key back to (fund, side); the delimiter is literal text."""
    key = _col(key)
    return F.substring_index(key, delim, 1), F.substring_index(key, delim, -1)


def parse_yyyymmdd(c) -> Column:
    """Op 16: text ``yyyyMMdd`` to a calendar date (NULL when unparsable)."""
    return F.to_date(_col(c), "yyyyMMdd")


def format_yyyymmdd(c) -> Column:
    """Op 16: date to ``yyyyMMdd`` text."""
    return F.date_format(_col(c), "yyyyMMdd")


def strict_double(c) -> Column:
    """Op 17: text to double; a malformed value fails the job, as in the reference."""
    c = _col(c)
    return F.when(c.isNull(), F.lit(None).cast("double")).otherwise(
        F.coalesce(c.try_cast("double"),
                   F.raise_error(F.concat(F.lit("not a number: "), c)).cast("double")))


def lenient_double(c) -> Column:
    """Op 17 (lenient): text to double, NULL when malformed."""
    return _col(c).try_cast("double")


def two_decimals(c) -> Column:
    """Op 17: ``%.2f`` text of a double."""
    return F.format_string("%.2f", _col(c))
