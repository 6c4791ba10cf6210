"""Baskets, overlap similarity and target search (ops 30-32, 36-39).

A basket is the set of accounts of one flagged (day, fund, side).  Baskets are
kept in long form (one row per basket and account); set comparisons are joins
on the account column followed by a count per pair, never cross joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flockwatch.operators.overlap import PLAIN_PAIRS_PER_ROW, inverted_index_size, overlap_above
from flockwatch.session import materialize
from flockwatch.operators.ranking import global_positions

BASKET_KEYS = ["trade_date", "fund", "side"]

# Fixed values that must equal the reference's: similarity thresholds.
HIGH_RATIO = 0.8
LOW_RATIO = 0.2
CONTAINMENT = 0.8


def basket_members(flagged_trades: DataFrame) -> DataFrame:
    """Op 30 (long form): distinct (day, fund, side, account)."""
    return flagged_trades.select(*BASKET_KEYS, "acct_key").distinct()


def basket_sizes(members: DataFrame) -> DataFrame:
    """Distinct accounts per basket (partial counts map-side; skew-safe)."""
    return members.groupBy(*BASKET_KEYS).agg(F.count(F.lit(1)).alias("basket_size"))


def basket_sets(members: DataFrame) -> DataFrame:
    """Op 30 (set view): one sorted account array per basket."""
    return members.groupBy(*BASKET_KEYS).agg(
        F.array_sort(F.collect_set("acct_key")).alias("accts"),
        F.count(F.lit(1)).alias("basket_size"))


def ordered_baskets(members: DataFrame) -> DataFrame:
    """Baskets with ``ord``: position by (size, day, fund, side) (decision D5)."""
    sizes = basket_sizes(members)
    return global_positions(sizes, ["basket_size", *BASKET_KEYS], "ord")


def with_ord(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(long members with ord, ordered basket table)."""
    ob = ordered_baskets(members)
    return members.join(ob, BASKET_KEYS), ob


# ---------------------------------------------------------------------------
# Overlap between two families of sets (op 31)
# ---------------------------------------------------------------------------

def _sides(m: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members twice, as (a, a_n, account) and (b, b_n, account): position and size of their basket."""
    return tuple(m.select(F.col("ord").alias(x), F.col("basket_size").alias(f"{x}_n"), "acct_key") for x in "ab")


def basket_overlap_pairs(members: DataFrame, threshold: float = HIGH_RATIO,
                         strict: bool = True, prefix_filter: bool | None = None) -> DataFrame:
    """Op 31 over flagged baskets: pairs (a earlier than b) above the threshold.

    Uses the overlap join of ``operators.overlap``: prefix-filtered whenever the
    plain inverted index would emit too many rows, so an account in most
    baskets does not make the candidate set quadratic.
    """
    m, ob = with_ord(members)
    a, b = _sides(m)
    pairs = (overlap_above(a, b, ["a", "a_n"], ["b", "b_n"], threshold, strict, prefix_filter=prefix_filter,
                           pairs=F.expr("a < b"), lsize="a_n", rsize="b_n").select("a", "b", "overlap", "coef"))
    sa = ob.select(F.col("ord").alias("a"), *[F.col(k).alias(f"a_{k}") for k in BASKET_KEYS],
                   F.col("basket_size").alias("a_size"))
    sb = ob.select(F.col("ord").alias("b"), *[F.col(k).alias(f"b_{k}") for k in BASKET_KEYS],
                   F.col("basket_size").alias("b_size"))
    return pairs.join(sa, "a").join(sb, "b").drop("a", "b")


def best_match(candidates: DataFrame, key: str, target: str, coef: str = "coef",
               age: str | None = None) -> DataFrame:
    """Op 32: per ``key`` the ``target`` with the highest coefficient.

    Ties go to the oldest target (smallest ``age``, default the target id) —
    decision D6.  Rows with coefficient 0 never win (strict ``>`` from 0).
    An arg-max aggregate (max over a (coef, -age, ...) struct), so candidates
    are combined map-side before the shuffle, however many one key has.
    """
    age = age or target
    others = [c for c in candidates.columns if c != key]
    best = F.max(F.struct(F.col(coef).alias("_bm_c"), (-F.col(age)).alias("_bm_a"),
                          *[F.col(c) for c in others])).alias("_bm")
    return (candidates.filter(F.col(coef) > 0).groupBy(key).agg(best)
                      .select(key, *[F.col(f"_bm.{c}").alias(c) for c in others]))


CASCADE = (0.8, 0.5, 0.3, 0.2, 0.1)


def basket_best_match(members: DataFrame, cascade=CASCADE) -> DataFrame:
    """Op 32 over baskets: for each basket, the best other basket (ties: lowest ord).

    When the plain inverted index is small enough (size check of
    ``operators.overlap``) it gives all sharing pairs at once.  Otherwise the
    bound falls: at each threshold t the prefix-filtered join finds the pairs
    above t for the baskets not yet resolved; a basket with any pair above t
    has its best among them (ties included), so it is resolved exactly and
    leaves.  After ``cascade`` the bound is halved.  Two baskets that share an
    account have a coefficient of at least 1 / size of either, so the search
    ends when t is below that for every basket left: those have no partner.
    Prefixes grow only for baskets whose best partner is still unknown.
    """
    m, ob = with_ord(members)
    a, b = _sides(m)
    sizes = {"lsize": "a_n", "rsize": "b_n", "pairs": F.expr("a <> b")}
    pairs_n, rows_n = inverted_index_size(a, b, ["acct_key"])
    if pairs_n <= PLAIN_PAIRS_PER_ROW * max(rows_n, 1):
        found = [overlap_above(a, b, ["a", "a_n"], ["b", "b_n"], 0.0, True, prefix_filter=False, **sizes)]
    else:
        # A basket whose accounts are all its own has no partner and takes no part.
        common = m.groupBy("acct_key").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
        sharing = a.join(common, "acct_key", "left_semi").select("a").distinct()
        found, left = [], a.join(sharing, "a", "left_semi")
        levels, t = iter(cascade), 1.0
        while True:
            t = next(levels, t / 2)
            hits = overlap_above(left, b, ["a", "a_n"], ["b", "b_n"], t, True, prefix_filter=True, **sizes)
            # Only each basket's best of this level is written, not all its pairs.
            hits = materialize(best_match(hits.select("a", "b", "overlap", "coef"), "a", "b"), "best_match_level")
            found.append(hits)
            left = left.join(hits.select("a"), "a", "left_anti")
            largest = left.agg(F.max("a_n")).first()[0]
            if largest is None or t * largest < 1:
                break
    pairs = found[0].select("a", "b", "overlap", "coef")
    for more in found[1:]:
        pairs = pairs.unionByName(more.select("a", "b", "overlap", "coef"))
    best = best_match(pairs, "a", "b")
    keys_a = ob.select(F.col("ord").alias("a"), *BASKET_KEYS)
    keys_b = ob.select(F.col("ord").alias("b"), *[F.col(k).alias(f"match_{k}") for k in BASKET_KEYS])
    return (best.join(keys_a, "a").join(keys_b, "b")
                .select(*BASKET_KEYS, *[f"match_{k}" for k in BASKET_KEYS], "overlap", "coef"))


# ---------------------------------------------------------------------------
# Target set and its searches (ops 36-39)
# ---------------------------------------------------------------------------

def target_accounts(members: DataFrame, trade_date, fund: str, side: str) -> DataFrame:
    """Op 36: the accounts of one (day, fund, side)."""
    return (members.filter((F.col("trade_date") == F.lit(trade_date).cast("date"))
                           & (F.col("fund") == fund) & (F.col("side") == side))
                   .select("acct_key").distinct())


def containment_search(members: DataFrame, target: DataFrame, threshold: float = CONTAINMENT) -> DataFrame:
    """Op 37: baskets B with |T n B| / |T| > threshold, ordered by basket size.

    An empty target yields no rows.  The join is on the account column; the
    planner broadcasts the target when its size in bytes allows.
    """
    tb = target.select("acct_key").distinct()
    t_size = tb.count()
    if t_size == 0:
        return members.limit(0).select(*BASKET_KEYS, F.lit(0).cast("long").alias("overlap"),
                                       F.lit(0).cast("long").alias("basket_size"),
                                       F.lit(0).cast("long").alias("t_size"))
    hits = members.join(tb, "acct_key").groupBy(*BASKET_KEYS).agg(F.count(F.lit(1)).alias("overlap"))
    sizes = basket_sizes(members)
    return (hits.filter(F.col("overlap") / F.lit(float(t_size)) > threshold)
                .join(sizes, BASKET_KEYS)
                .select(*BASKET_KEYS, "overlap", "basket_size",
                        F.lit(t_size).cast("long").alias("t_size"))
                .orderBy("basket_size", *BASKET_KEYS))


def target_vs_sets(model_members: DataFrame, target: DataFrame) -> DataFrame:
    """Op 38: models whose overlap with T reaches the model's min size.

    Reports (model_id, min_size, overlap / |model|, overlap).  Returned as a
    DataFrame, the rows the reference meant to collect (D8).
    """
    t = target.select("acct_key").distinct()
    mm = model_members.select("model_id", "min_size", "acct_key").distinct()
    sizes = mm.groupBy("model_id", "min_size").agg(F.count(F.lit(1)).alias("model_size"))
    hits = mm.join(t, "acct_key").groupBy("model_id", "min_size").agg(
        F.count(F.lit(1)).alias("overlap"))
    return (hits.filter(F.col("overlap") >= F.col("min_size"))
                .join(sizes, ["model_id", "min_size"])
                .select("model_id", "min_size",
                        (F.col("overlap") / F.col("model_size")).alias("model_ratio"), "overlap"))


def target_coverage(model_members: DataFrame, target: DataFrame) -> DataFrame:
    """Op 39: percentage of T in no model: 100 * |T minus all model accounts| / |T|.

    One row: (uncovered, target_size, pct_uncovered, pct_text) — the text with
    a percent sign as the reference prints it.  Empty T gives NULL.
    """
    t = target.select("acct_key").distinct()
    covered = model_members.select("acct_key").distinct().withColumn("_in_model", F.lit(1))
    joined = t.join(covered, "acct_key", "left")
    counts = joined.agg(F.count(F.lit(1)).alias("target_size"),
                        F.count(F.when(F.col("_in_model").isNull(), 1)).alias("uncovered"))
    pct = F.when(F.col("target_size") > 0, 100.0 * F.col("uncovered") / F.col("target_size"))
    return (counts.select("uncovered", "target_size", pct.alias("pct_uncovered"))
                  .withColumn("pct_text", F.concat(F.col("pct_uncovered").cast("string"), F.lit("%"))))
