"""Recurring-set mining as a fixpoint over a versioned store of sets (ops 33-35).

The reference walks the baskets one at a time in order of size, each reading
all current sets ("models") and possibly writing some.  Here all baskets of a
pass are worked out at once, each against the versions that earlier baskets
are known to have written so far; baskets to which a changed version matters
are worked out again, until nothing changes.  What stands then is the walk's
result: the first basket never depends on another one, and a basket is right
as soon as the earlier ones that matter to it are.  So a pass takes as many
rounds as the longest chain of baskets that really change each other, however
many baskets share an account.

Rules, per basket B with best match M (overlap coefficient r, overlap n),
b = |B| - n, m = |M| - n and a minimum size s:
  R1  r <= low: if |B| >= s, B becomes a new model (no existence check).
  R2  low < r <= high: if b >= s, propose B minus M.
  R3  r > high:  b >= s, m < s: propose B minus M and count M;
                 m >= s, b < s: reduce M, propose M minus B;
                 both >= s: reduce M, propose B minus M, propose M minus B;
                 neither: count M.
  R4  propose P: if P's best match (after this basket's reduction) is > high,
      count that model instead; else P is a new model credited with B.
  R5  reduce: M becomes M n B as a new version credited with B, only if
      |M n B| > s.
  R6  passes: occurrences are cleared at the start of every pass; models stay.
A model is reported when its current version was credited by more than one
distinct basket in the last pass (D7).  Ties in a best match go to the oldest
lineage (D6).

Store.  A version is (ms, lin, vord): the set that basket ``vord`` gave lineage
``lin`` at min size ``ms`` (-1: it stood before the pass).  Basket o sees, of each
lineage, the last version with vord < o.  Rounds append what the baskets they
worked out decided (the decisions alone first, then the ``plan`` with the
accounts), what they wrote and counted (``out``), and the baskets that the
changes reach (``reached``): four tables a round, never rewritten; of a basket
the rows of its last round hold.  All min sizes run together.

A changed version (added, gone, or of a lineage that was shrunk elsewhere)
reaches a later basket if it is at least as good a match for it as its own
best (above ``low`` when it has none), if it belongs to the lineage it matched, or
if its coefficient with a checked proposal is above ``high``.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flockwatch.operators.baskets import BASKET_KEYS, HIGH_RATIO, LOW_RATIO, ordered_baskets
from flockwatch.operators.overlap import PLAIN_PAIRS_PER_ROW, inverted_index_size, overlap_above
from flockwatch.operators.ranking import global_positions
from flockwatch.session import ensure_checkpoint_dir, scratch_path

# Fixed values that must equal the reference's defaults: minimum set sizes
# 50, 100 and 200; 5 passes.
DEFAULT_MIN_SIZES = (50, 100, 200)
DEFAULT_ITERATIONS = 5

MS_ORD = ["ms", "ord"]
VERSION = ["ms", "lin", "vord"]
_BASE_SCHEMA = "ms int, lin long, vage long, size long, acct_key string"


@dataclass
class MiningResult:
    members: DataFrame      # (model_id, min_size, acct_key) of repeated sets
    trades: DataFrame       # (model_id, min_size, trade_date, fund, side)
    sets: DataFrame         # every current set: (model_id, min_size, set_size, n_baskets, repeated)
    rounds: list            # rounds per pass
    scratch_dir: str = ""   # folder holding this run's tables; delete it once results are written


def _writer(folder: str):
    """A function that writes a step as Parquet under the run's scratch folder and reads it back."""
    def write(df: DataFrame) -> DataFrame:
        path = os.path.join(folder, f"step-{uuid.uuid4().hex[:12]}")
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)
    return write


def recurring_sets(members: DataFrame, min_sizes=DEFAULT_MIN_SIZES,
                   iterations: int = DEFAULT_ITERATIONS, high: float = HIGH_RATIO,
                   low: float = LOW_RATIO, max_rounds: int = 100_000,
                   prefix_filter: bool | None = None) -> MiningResult:
    """Op 33-35 over basket members (trade_date, fund, side, acct_key).

    ``prefix_filter`` is passed to every overlap join: True or False forces
    one; None (default) counts once what an inverted index of the baskets with
    themselves would emit (models are parts of baskets, at most two more per
    basket and pass) and takes the prefix-filtered join when that is too much.
    """
    spark = members.sparkSession
    ensure_checkpoint_dir(spark)
    folder = scratch_path(spark, "mining-run")
    write = _writer(folder)
    ob = write(ordered_baskets(members))
    min_sizes = [int(x) for x in min_sizes]
    baskets = write(members.join(ob, BASKET_KEYS)
                    .select("ord", F.col("basket_size").alias("bsize"), "acct_key")
                    .withColumn("ms", F.explode(F.array(*[F.lit(x) for x in min_sizes]))))
    if prefix_filter is None:
        one = baskets.where(F.col("ms") == min_sizes[0])
        pairs, rows = inverted_index_size(one, one, ["acct_key"])
        prefix_filter = pairs > PLAIN_PAIRS_PER_ROW * max(rows, 1)
    base, occ = spark.createDataFrame([], _BASE_SCHEMA), None
    n_baskets, rounds_per_pass = ob.count(), []
    for it in range(iterations):
        one_pass = _Pass(write, baskets, base, it * n_baskets, high, low, prefix_filter)
        rounds_per_pass.append(one_pass.run(max_rounds))
        base, occ = write(one_pass.models_after()), one_pass.credits()
    res = _finish(write, ob, base, occ, min_sizes, rounds_per_pass)
    res.scratch_dir = folder
    return res


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


class _Pass:
    """One pass over the baskets; ``before`` baskets have been walked in earlier passes."""

    def __init__(self, write, baskets, base, before, high, low, prefix_filter):
        self.write, self.baskets, self.base = write, baskets, base
        self.before, self.high, self.low, self.prefix = before, high, low, prefix_filter
        self.plans: list[DataFrame] = []        # per round: what its baskets decided
        self.outs: list[DataFrame] = []         # per round: what they wrote and counted
        self.turns: list[DataFrame] = []        # per round: its baskets (ms, ord, bsize)

    def run(self, max_rounds: int) -> int:
        turn = self.baskets.select(*MS_ORD, "bsize").distinct()
        while True:
            k = len(self.plans)
            if k == max_rounds:
                raise RuntimeError(f"a mining pass did not finish in {max_rounds} rounds")
            versions = self._versions()
            plan = self.write(self._plan(turn, versions))
            out = self.write(self._out(plan, versions))
            old = self._writes() if k else None
            self.plans.append(plan)
            self.outs.append(out)
            self.turns.append(turn)
            turn = self.write(self._reached(old, versions, k))
            if turn.isEmpty():
                return k + 1

    def _overlap(self, left, right, lkeys, rkeys, t, pairs):
        return overlap_above(left, right, [*lkeys, "size"], [*rkeys, "other_size"], t, True, shared=["ms"],
                             prefix_filter=self.prefix, pairs=pairs, lsize="size", rsize="other_size")

    # The store ------------------------------------------------------------

    def _last(self, tables: list[DataFrame]) -> DataFrame:
        """Rows of every basket's last round among ``tables`` (one per round)."""
        rows = _all([t.withColumn("k", F.lit(k)) for k, t in enumerate(tables)])
        if len(tables) > 1:
            again = _all([self.turns[k].select(F.col("ms").alias("_m"), F.col("ord").alias("_o"), F.lit(k).alias("_k"))
                          for k in range(1, len(tables))])
            rows = rows.join(again, (F.col("ms") == F.col("_m")) & (F.col("ord") == F.col("_o")) & (F.col("k") < F.col("_k")),
                             "left_anti")
        return rows.drop("k")

    def _writes(self) -> DataFrame:
        """(ms, ord, wid, lin, size, acct_key): the sets that stand now; wid 0, 1 new ones, 3 the shrunk match."""
        return self._last(self.outs).where("kind = 'set'").select(*MS_ORD, "wid", "lin", "size", "acct_key")

    def _versions(self) -> DataFrame:
        """(ms, lin, vord, vnext, size, acct_key): the sets as earlier baskets know them, seen by baskets in (vord, vnext]."""
        end = F.lit((1 << 62)).cast("long")
        base = self.base.select("ms", "lin", F.lit(-1).cast("long").alias("vord"), "size", "acct_key")
        if not self.plans:
            return base.withColumn("vnext", end)
        written = self._writes().withColumnRenamed("ord", "vord")
        shrunk = self._last(self.outs).where("kind = 'shrunk'").select("ms", "lin", F.col("ord").alias("vord"))
        order = Window.partitionBy("ms", "lin").orderBy("vord")
        after = shrunk.withColumn("_next", F.lead("vord").over(order))
        first = shrunk.groupBy("ms", "lin").agg(F.min("vord").alias("_first"))
        rows = base.withColumn("wid", F.lit(0)).unionByName(written)
        return (rows.join(after, VERSION, "left").join(first, ["ms", "lin"], "left")
                .withColumn("vnext", F.coalesce(F.when(F.col("wid") == 3, F.col("_next")).otherwise(F.col("_first")), end))
                .select(*VERSION, "vnext", "size", "acct_key"))

    # A round --------------------------------------------------------------

    def _plan(self, turn, versions) -> DataFrame:
        """Decisions ('mt') of the baskets of a round, and the accounts of basket and match ('cell').

        ``pos`` of a cell: 0 and 1 proposals, 3 the shrunk match.  Only matches
        above ``low`` change what a basket does (R1 ignores the model).
        """
        pb = self.baskets.join(turn.select(*MS_ORD), MS_ORD, "left_semi").select(*MS_ORD, "bsize", "acct_key")
        ov = self._overlap(pb.withColumnRenamed("bsize", "size"), versions.withColumnRenamed("size", "other_size"),
                           ["ord"], ["lin", "vord", "vnext"], self.low, F.expr("vord < ord and ord <= vnext"))
        # Arg-max (coefficient, then the oldest lineage): combined map-side, skew-safe.
        best = (ov.groupBy(*MS_ORD)
                .agg(F.max(F.struct("coef", (-F.col("lin")).alias("_old"), "lin", "vord", "overlap", "rsize")).alias("_b"))
                .select(*MS_ORD, "_b.lin", "_b.vord", F.col("_b.overlap").alias("n"), F.col("_b.rsize").alias("msize"),
                        F.col("_b.coef").alias("r")))
        mt = turn.select(*MS_ORD, "bsize").join(best, MS_ORD, "left").fillna({"n": 0, "r": 0.0})
        ms, r, n = F.col("ms"), F.col("r"), F.col("n")
        b_left, m_left = F.col("bsize") - n, F.col("msize") - n
        near, far = r > self.high, r <= self.low
        want_bmm = ~far & (b_left >= ms)
        mt = mt.select(*MS_ORD, "bsize", "lin", "vord", "msize", "n", "r",
                       (far & (F.col("bsize") >= ms)).alias("want_w"), want_bmm.alias("want_bmm"),
                       F.coalesce(near & (m_left >= ms), F.lit(False)).alias("want_mmb"),
                       F.when(want_bmm, 1).otherwise(0).alias("pos_mmb"),
                       F.coalesce(near & (m_left >= ms) & (n > ms), F.lit(False)).alias("reduce"),
                       F.coalesce(near & (m_left < ms), F.lit(False)).alias("count_m"))
        # Written, so that joins see its size: a row per basket, next to the accounts of all baskets.
        mt = self.write(mt)
        in_b, in_m = F.col("in_b"), F.col("in_m")
        mine = pb.select(*MS_ORD, "acct_key", F.lit(True).alias("in_b"), F.lit(False).alias("in_m"))
        match = (versions.select(*VERSION, "acct_key").join(mt.where(~far).select(*MS_ORD, "lin", "vord"), VERSION)
                 .select(*MS_ORD, "acct_key", F.lit(False).alias("in_b"), F.lit(True).alias("in_m")))
        # Accounts are grouped by their keys alone and over many tasks; the decisions join the result.
        cells = (mine.unionByName(match).groupBy(*MS_ORD, "acct_key").agg(F.max(in_b).alias("in_b"), F.max(in_m).alias("in_m"))
                 .join(mt, MS_ORD))
        pos = (F.when((F.col("want_w") & F.col("in_b")) | (F.col("want_bmm") & F.col("in_b") & ~F.col("in_m")), 0)
               .when(F.col("want_mmb") & F.col("in_m") & ~F.col("in_b"), F.col("pos_mmb"))
               .when(F.col("reduce") & F.col("in_b") & F.col("in_m"), 3))
        size = F.when(pos == 3, n).when(F.col("want_w"), F.col("bsize")).when(F.col("in_b"), b_left).otherwise(m_left)
        cells = cells.select(*MS_ORD, "acct_key", "bsize", "lin", "r", "reduce", "in_b", pos.alias("pos"), size.alias("size"),
                             (~F.col("want_w")).alias("checked"))
        return _all([x.withColumn("kind", F.lit(k)) for k, x in (("mt", mt), ("cell", cells))])

    def _out(self, plan, versions) -> DataFrame:
        """What the baskets of a plan write ('set', and 'shrunk' per lineage) and the models their proposals count ('count').

        R4: a checked proposal counts its best model above ``high`` instead of
        becoming one.  The lineage that the basket itself shrinks is out: its
        new version is disjoint from both kinds of proposals.
        """
        cells = plan.where("kind = 'cell' and pos is not null")
        offers = cells.where("checked and pos < 3").select(
            *MS_ORD, "pos", F.when(F.col("reduce"), F.col("lin")).otherwise(F.lit(-1).cast("long")).alias("own"), "size", "acct_key")
        ov = self._overlap(offers, versions.withColumnRenamed("size", "other_size"), ["ord", "pos", "own"],
                           ["lin", "vord", "vnext"], self.high, F.expr("vord < ord and ord <= vnext and lin <> own"))
        counted = (ov.groupBy(*MS_ORD, "pos")
                   .agg(F.max(F.struct("coef", (-F.col("lin")).alias("_old"), "lin", "vord")).alias("_b"))
                   .select(*MS_ORD, "pos", "_b.lin", "_b.vord"))
        start = (F.lit(self.before).cast("long") + F.col("ord")) * 4
        sets = (cells.join(counted.select(*MS_ORD, "pos"), [*MS_ORD, "pos"], "left_anti")
                .select(*MS_ORD, F.col("pos").alias("wid"),
                        F.when(F.col("pos") == 3, F.col("lin")).otherwise(start + F.col("pos")).alias("lin"), "size", "acct_key"))
        shrunk = plan.where("kind = 'mt' and reduce").select(*MS_ORD, "lin")
        return _all([x.withColumn("kind", F.lit(k)) for k, x in (("set", sets), ("count", counted), ("shrunk", shrunk))])

    def _reached(self, old, versions, k) -> DataFrame:
        """(ms, ord, bsize) of the baskets that the changes of round ``k`` reach."""
        turn = self.turns[k].select(*MS_ORD)
        new = self.outs[k].where("kind = 'set'").select(*MS_ORD, "wid", "lin", "size", "acct_key")
        key = [*MS_ORD, "wid", "lin"]
        as_delta = ["ms", "lin", F.col("ord").alias("x"), F.col("ord").alias("vord"), "gen", "size", "acct_key"]
        if old is None:
            delta = new.withColumn("gen", F.lit(1)).select(*as_delta)
            shrunk = self.outs[k].where("kind = 'shrunk'")
        else:
            both = (new.withColumn("gen", F.lit(1))
                    .unionByName(old.join(turn, MS_ORD, "left_semi").withColumn("gen", F.lit(-1))))
            changed = (both.groupBy(*key, "acct_key").agg(F.sum("gen").alias("_d")).where("_d <> 0").select(*key).distinct())
            delta = both.join(changed, key, "left_semi").select(*as_delta)
            shrunk = changed.where("wid = 3")
        # Where a shrink came or went, the versions before it begin or cease to be seen.
        where = shrunk.groupBy("ms", "lin").agg(F.min("ord").alias("x"))
        delta = delta.unionByName(versions.join(where, ["ms", "lin"])
                                  .select("ms", "lin", "x", "vord", F.lit(0).alias("gen"), "size", "acct_key"))
        cells = self._last(self.plans).where("kind = 'cell'")
        reads = (cells.where("in_b").select("ms", F.col("ord").alias("o"), "bsize", F.lit(-1).alias("side"), "r",
                                            F.coalesce("lin", F.lit(-1).cast("long")).alias("match"),
                                            F.col("bsize").alias("other_size"), "acct_key")
                 .unionByName(cells.where("checked and pos < 3").select(
                     "ms", F.col("ord").alias("o"), "bsize", F.col("pos").alias("side"), "r",
                     F.lit(-1).cast("long").alias("match"), F.col("size").alias("other_size"), "acct_key")))
        met = self._overlap(delta, reads, ["lin", "x", "vord", "gen"], ["o", "bsize", "side", "r", "match"], self.low,
                            F.expr("x < o"))
        coef, r = F.col("coef"), F.col("r")
        matters = F.when(F.col("side") < 0, (r <= self.low) | (coef >= r) | (F.col("lin") == F.col("match"))).otherwise(
            coef > self.high)
        return met.where(matters).select("ms", F.col("o").alias("ord"), "bsize").distinct()

    # After the last round -------------------------------------------------

    def models_after(self) -> DataFrame:
        """(ms, lin, vage, acct_key): the last version of every lineage."""
        start = (F.lit(self.before).cast("long") + F.col("ord")) * 4
        written = self._writes().withColumn("vage", start + F.col("wid"))
        shrunk = self._last(self.outs).where("kind = 'shrunk'").groupBy("ms", "lin").agg(F.max("ord").alias("_last"))
        rows = self.base.drop("vord").withColumn("ord", F.lit(-1).cast("long")).unionByName(written.drop("wid"))
        return (rows.join(shrunk, ["ms", "lin"], "left").where("_last is null or ord = _last")
                .select("ms", "lin", "vage", F.col("ord").alias("vord"), "size", "acct_key"))

    def credits(self) -> DataFrame:
        """(ms, lin, vord, ord): the baskets that made or counted each version in this pass."""
        mt = self._last(self.plans).where("kind = 'mt'")
        return (self._writes().select("ms", "lin", F.col("ord").alias("vord"), "ord").distinct()
                .unionByName(mt.where("count_m").select("ms", "lin", "vord", "ord"))
                .unionByName(self._last(self.outs).where("kind = 'count'").select("ms", "lin", "vord", "ord")).distinct())


def _finish(write, ob, models, occ, min_sizes, rounds):
    if occ is None:         # no pass: no models
        models = models.withColumn("vord", F.lit(-1).cast("long"))
        occ = models.select(*VERSION, F.lit(0).cast("long").alias("ord"))
    sets = (models.select(*VERSION, "vage", F.col("size").alias("msize")).distinct()
            .join(occ.groupBy(*VERSION).agg(F.count(F.lit(1)).alias("n_baskets")), VERSION, "left").fillna({"n_baskets": 0})
            .withColumn("_msorder", F.array_position(F.array(*[F.lit(x) for x in min_sizes]), F.col("ms"))))
    sets = global_positions(sets, ["_msorder", "vage", "lin"], "model_id")
    sets = write(sets.select("model_id", F.col("ms").cast("long").alias("min_size"), *VERSION,
                             F.col("msize").alias("set_size"), "n_baskets", (F.col("n_baskets") > 1).alias("repeated")))
    rep = sets.where("repeated")
    return MiningResult(members=rep.join(models, VERSION).select("model_id", "min_size", "acct_key"),
                        trades=(rep.join(occ, VERSION).join(ob.select("ord", *BASKET_KEYS), "ord")
                                .select("model_id", "min_size", *BASKET_KEYS)),
                        sets=sets.drop(*VERSION), rounds=rounds)
