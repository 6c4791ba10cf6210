"""Column expressions (all JVM-side built-ins, no Python UDFs)."""

from flockwatch.functions.keys import (
    INVALID_KEY, SENTINELS, TRADE_DELIM, cascade_key, fund_side_key, labelled_cascade,
    parse_yyyymmdd, format_yyyymmdd, sentinel_to_null, split_fund_side, strict_double,
    lenient_double, two_decimals,
)
from flockwatch.functions.stats import guarded_z, share_of_total
from flockwatch.functions.sets import overlap_coefficient, set_difference, set_intersection

__all__ = [
    "INVALID_KEY", "SENTINELS", "TRADE_DELIM", "cascade_key", "fund_side_key",
    "labelled_cascade", "parse_yyyymmdd", "format_yyyymmdd", "sentinel_to_null",
    "split_fund_side", "strict_double", "lenient_double", "two_decimals", "guarded_z",
    "share_of_total", "overlap_coefficient", "set_difference", "set_intersection",
]
