"""Exact overlap-coefficient join above a threshold, with prefix filtering.

Pairs (L, R) with |L n R| / min(|L|, |R|) > t (or >= t).  A plain inverted
index on the item emits every pair of sets that share an item, so one item in
a third of all sets makes the join quadratic in that item's frequency.  Here
items are ordered globally by frequency, rarest first.  If S is the smaller
set of a qualifying pair, the pair needs at least tau(|S|) shared items, so at
least one of S's first |S| - tau(|S|) + 1 items (its prefix) is shared.
Candidates therefore come from a join of prefixes of the smaller side with
all items of the larger side: a frequent item sits at the end of every order
and only enters the prefix of sets made almost entirely of frequent items.
Candidates are then verified exactly.

The prefix is taken by frequency: an item is kept when fewer than
|S| - tau(|S|) + 1 items of its set are strictly rarer.  This keeps every item
of the exact prefix (and the items tied with its last one), so the filter
stays exact.  It needs no sort inside a set: a per-set histogram of item
frequencies (partial aggregation) and a running sum over it, whose window
holds one row per distinct frequency value -- at most sqrt(2N) rows for N
items, however large the set.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def required_overlap(size: Column, t: float, strict: bool) -> Column:
    """tau(s): the least overlap with a set of size s that passes the threshold.

    Rounded down by a hair against floating error: a smaller tau only makes the
    prefix longer, which keeps the filter exact.
    """
    if strict:
        tau = F.floor(F.lit(t) * size - F.lit(1e-9)) + 1
    else:
        tau = F.ceil(F.lit(t) * size - F.lit(1e-9))
    return F.greatest(tau, F.lit(1)).cast("long")


def _prefix(items: DataFrame, set_cols: list[str], size_col: str, t: float,
            strict: bool) -> DataFrame:
    """Items of each set that lie in (a superset of) its prefix."""
    hist = items.groupBy(*set_cols, "_f").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*set_cols).orderBy("_f").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("_rarer", F.coalesce(F.sum("_c").over(w), F.lit(0)))
    size = F.col(size_col)
    cut = size - required_overlap(size, t, strict) + 1
    return (items.join(hist.select(*set_cols, "_f", "_rarer"), set_cols + ["_f"])
                 .filter(F.col("_rarer") < cut))


# The plain inverted index is used only while the number of (left, right, item)
# rows it would emit stays within this multiple of the input rows.
PLAIN_PAIRS_PER_ROW = 20.0


def inverted_index_size(L: DataFrame, R: DataFrame, keys: list[str]) -> tuple[int, int]:
    """(rows the plain inverted-index join would emit, input rows): one small
    aggregation per side, joined on the item."""
    lc = L.groupBy(*keys).agg(F.count(F.lit(1)).alias("_lc"))
    rc = R.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rc"))
    row = (lc.join(rc, keys, "full")
             .agg(F.sum(F.coalesce(F.col("_lc"), F.lit(0)) * F.coalesce(F.col("_rc"), F.lit(0)))
                  .alias("pairs"),
                  F.sum(F.coalesce(F.col("_lc"), F.lit(0)) + F.coalesce(F.col("_rc"), F.lit(0)))
                  .alias("rows"))
             .first())
    return int(row.pairs or 0), int(row.rows or 0)


def overlap_above(left: DataFrame, right: DataFrame, lkeys: list[str], rkeys: list[str],
                  t: float, strict: bool = True, item: str = "acct_key",
                  shared: list[str] | None = None, prefix_filter: bool | None = None,
                  pairs: Column | None = None, lsize: str | None = None, rsize: str | None = None) -> DataFrame:
    """Pairs above the threshold: lkeys + rkeys + (overlap, lsize, rsize, coef).

    ``shared`` columns (e.g. a min-size key) must be equal on both sides and are
    part of both set keys; ``lkeys``/``rkeys`` must not collide.
    ``prefix_filter``: True always filters, False always uses the plain
    inverted index, None (default) counts what the plain index would emit and
    uses it only within ``PLAIN_PAIRS_PER_ROW`` times the input rows.
    ``pairs``, a condition on the keys, holds where pairs are made: other pairs
    are never counted, shuffled or verified.
    ``lsize`` / ``rsize`` name a key that holds the set's size already; the rows of
    that side are then taken as distinct, and no size is counted.
    """
    shared = shared or []
    wanted = F.lit(True) if pairs is None else pairs
    L, R = left.select(*shared, *lkeys, item), right.select(*shared, *rkeys, item)
    L, R = L if lsize else L.distinct(), R if rsize else R.distinct()
    lset, rset = shared + lkeys, shared + rkeys
    if prefix_filter is None:
        pairs_n, rows_n = inverted_index_size(L, R, shared + [item])
        prefix_filter = pairs_n > PLAIN_PAIRS_PER_ROW * max(rows_n, 1)
    def with_size(rows, keys, known, name):
        if known:
            return rows.withColumn(name, F.col(known).cast("long"))
        return rows.join(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)), keys)

    if prefix_filter:
        freq = (L.select(*shared, item).unionAll(R.select(*shared, item))
                 .groupBy(*shared, item).agg(F.count(F.lit(1)).alias("_f")))
        Lp = with_size(L.join(freq, shared + [item]), lset, lsize, "_ls")
        Rp = with_size(R.join(freq, shared + [item]), rset, rsize, "_rs")
        l_pre = _prefix(Lp, lset, "_ls", t, strict)
        r_pre = _prefix(Rp, rset, "_rs", t, strict)
        # Left as the smaller (or equal) side: its prefix against all right items.
        c1 = (l_pre.select(*lset, item, "_ls")
                   .join(Rp.select(*rset, item, "_rs"), shared + [item])
                   .filter((F.col("_ls") <= F.col("_rs")) & wanted).select(*lset, *rkeys))
        # Right as the strictly smaller side.
        c2 = (r_pre.select(*rset, item, "_rs")
                   .join(Lp.select(*lset, item, "_ls"), shared + [item])
                   .filter((F.col("_rs") < F.col("_ls")) & wanted).select(*lset, *rkeys))
        cand = c1.unionByName(c2).distinct()
        # Exact verification of each candidate pair.
        found = (cand.join(L, lset).join(R, shared + rkeys + [item])
                     .groupBy(*lset, *rkeys).agg(F.count(F.lit(1)).alias("overlap")))
    else:
        found = (L.join(R, shared + [item]).filter(wanted).groupBy(*lset, *rkeys)
                  .agg(F.count(F.lit(1)).alias("overlap")))

    def sized(pairs_found, rows, keys, known, name):
        if known:
            return pairs_found.withColumn(name, F.col(known).cast("long"))
        return pairs_found.join(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)), keys)

    out = sized(sized(found, L, lset, lsize, "lsize"), R, rset, rsize, "rsize")
    out = out.withColumn("coef", F.col("overlap") / F.least("lsize", "rsize"))
    keep = F.col("coef") > t if strict else F.col("coef") >= t
    return out.filter(keep)


def prefix_length(size: int, t: float, strict: bool = True) -> int:
    """Plain-Python prefix length, for tests."""
    tau = math.floor(t * size - 1e-9) + 1 if strict else math.ceil(t * size - 1e-9)
    tau = max(tau, 1)
    return size - tau + 1
