"""Mixing sources to target weights by a min-cost flow.

Documents may belong to several sources.  They are aggregated by membership
pattern; a pattern's tokens may be used up to ``MAX_REPEATS`` times, and each
further pass costs more than the one before (convex costs).  The flow routes
pattern capacity to source quotas at least cost, so that documents repeat only
where a quota needs it, and the passes spread evenly over patterns.  What a
pattern must yield is then met by whole passes over all its documents plus a
seeded selection for the remainder: documents in seeded order, each taken if
it still fits, so that a very long one is passed over where it does not.

The flow works on one number per pattern and pass; components of the
pattern-source graph are solved one by one, and the number of patterns is
checked against ``MAX_PATTERNS`` before they come to the driver.  Selection is
distributed and goes in rounds: sums per (pattern, hash bucket) find the bucket
where a run of documents that fit ends, and only that bucket's documents are
summed one by one.  Rounds go on until no document is left that fits.

Defined cases: a null or empty text has size 0 and is never taken; a document
without source forms the source null, ranked last; an empty table gives an
empty result; repeated rows are each counted and taken.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flockwatch.llm.common import text_or_empty
from flockwatch.session import materialize

MAX_REPEATS = 3
PASS_COST = (0, 1, 3)       # convex: the second pass costs 1 more, the third 2 more
WEIGHTS = (5, 2, 1)         # by rank of the source, repeating
MAX_PATTERNS = 1_000_000    # checked; a pattern is one combination of sources
BUCKETS = 4096
SEED = 17


def n_words(col: Column) -> Column:
    return F.regexp_count(col, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets_for(sizes: dict, weights=WEIGHTS, cap: float = MAX_REPEATS) -> dict:
    """Target per source: weights share all sizes, no target above ``cap`` times its source."""
    ranked = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(ranked)}
    total = float(sum(sizes.values()))
    target, open_ = {}, list(ranked)
    while open_:
        left = total - sum(target.values())
        share = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / share > cap * sizes[s]]
        if not over:
            target.update({s: left * weight[s] / share for s in open_})
            break
        target.update({s: cap * float(sizes[s]) for s in over})
        open_ = [s for s in open_ if s not in target]
    return target


def _components(patterns: list[tuple]) -> list[list[tuple]]:
    """Patterns grouped so that patterns sharing a source are together."""
    root: dict = {}

    def find(s):
        while root.setdefault(s, s) != s:
            root[s] = root[root[s]]
            s = root[s]
        return s

    for p in patterns:
        for s in p[1:]:
            root[find(s)] = find(p[0])
    out = defaultdict(list)
    for p in patterns:
        if p:
            out[find(p[0])].append(p)
    return list(out.values())


def min_cost_flow(capacity: dict[tuple, int], quota: dict, costs=PASS_COST) -> dict[tuple, dict]:
    """Tokens that each pattern sends to each of its sources: {pattern: {source: tokens}}.

    Successive shortest paths with potentials: pattern passes are parallel
    edges of convex cost, pattern-source edges are free, sources end at their
    quota.
    """
    sent: dict[tuple, dict] = {}
    for patterns in _components(list(capacity)):
        nodes = {"S": 0, "T": 1}
        heads: list[list[int]] = [[], []]
        edges: list[list] = []      # to, capacity left, cost; edge ^ 1 is its reverse

        def node(x, nodes=nodes, heads=heads):
            if x not in nodes:
                nodes[x] = len(heads)
                heads.append([])
            return nodes[x]

        def add(a, b, cap, cost, edges=edges, heads=heads):
            heads[a].append(len(edges))
            edges.append([b, cap, cost])
            heads[b].append(len(edges))
            edges.append([a, 0, -cost])
            return len(edges) - 2

        route, ends = {}, {}
        for p in patterns:
            for cost in costs:
                add(0, node(("p", p)), capacity[p], cost)
            for s in p:
                route[p, s] = add(node(("p", p)), node(("s", s)), sum(capacity[p] for _ in costs), 0)
                if s not in ends:
                    ends[s] = add(node(("s", s)), 1, int(round(quota[s])), 0)
        pot = [0] * len(heads)
        while True:
            dist, via = [None] * len(heads), [None] * len(heads)
            queue, dist[0] = [(0, 0)], 0
            while queue:
                d, a = heapq.heappop(queue)
                if d > dist[a]:
                    continue
                for e in heads[a]:
                    b, cap, cost = edges[e]
                    if cap > 0 and (dist[b] is None or d + cost + pot[a] - pot[b] < dist[b]):
                        dist[b], via[b] = d + cost + pot[a] - pot[b], e
                        heapq.heappush(queue, (dist[b], b))
            if dist[1] is None:
                break
            reach = max(x for x in dist if x is not None)
            pot = [q + (reach if x is None else x) for q, x in zip(pot, dist, strict=True)]
            path, at = [], 1
            while at != 0:
                path.append(via[at])
                at = edges[via[at] ^ 1][0]
            push = min(edges[e][1] for e in path)
            for e in path:
                edges[e][1] -= push
                edges[e ^ 1][1] += push
        for p in patterns:
            sent[p] = {s: edges[route[p, s] ^ 1][1] for s in p}
    return sent


def _taken(runs: Column) -> Column:
    """Whether a row lies in one of the runs of its pattern."""
    return F.exists(runs, lambda r: (r["after"].isNull() | (F.col("_key") > r["after"])) & (F.col("_key") <= r["upto"])
                    & (F.col("_size") <= r["most"]))


def _one_round(narrow: DataFrame, marks: DataFrame) -> DataFrame:
    """``marks`` with one more run per open pattern; done are patterns with nothing left that could fit."""
    could = (narrow.join(F.broadcast(marks.where(~F.col("_done"))), F.col("_pattern") == F.col("_pp"))
             .where((F.col("_from").isNull() | (F.col("_key") > F.col("_from"))) & (F.col("_size") <= F.col("_open"))
                    & (F.col("_size") > 0))
             .select("_pp", "_open", "_bucket", "_key", "_size"))
    # The bucket in which what is left ends, and the tokens before it.
    upto = Window.partitionBy("_pp").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = (could.groupBy("_pp", "_open", "_bucket")
            .agg(F.sum("_size").alias("tokens"), F.max("_key").alias("end"))
            .withColumn("all", F.sum("tokens").over(upto)))
    whole = (sums.groupBy("_pp").agg(
        F.max(F.when(F.col("all") <= F.col("_open"), F.struct("all", "end"))).alias("whole"),
        F.min(F.when(F.col("all") > F.col("_open"), F.col("_bucket"))).alias("_cb")))
    whole = materialize(whole, "mix-cuts")
    cut = F.broadcast(whole.where(F.col("_cb").isNotNull())
                      .select(F.col("_pp").alias("_cp"), "_cb", F.coalesce("whole.all", F.lit(0)).alias("before")))
    inside = (could.join(cut, (F.col("_pp") == F.col("_cp")) & (F.col("_bucket") == F.col("_cb")))
              .withColumn("upto", F.col("before")
                          + F.sum("_size").over(Window.partitionBy("_pp").orderBy("_key"))))
    ends = inside.groupBy("_pp").agg(
        F.max(F.when(F.col("upto") <= F.col("_open"), F.struct(F.col("upto").alias("all"), F.col("_key").alias("end")))).alias("part"),
        F.min(F.when(F.col("upto") > F.col("_open"), F.col("_key"))).alias("stop"))
    got = (whole.join(ends, "_pp", "left")
           .select("_pp", F.coalesce("part", "whole").alias("got"), "stop"))
    run = F.struct(F.col("_from").alias("after"), F.col("got.end").alias("upto"), F.col("_open").alias("most"))
    left = F.col("_open") - F.coalesce(F.col("got.all"), F.lit(0))
    return (marks.join(F.broadcast(got), "_pp", "left")
            .select("_pp", left.alias("_open"), F.coalesce("stop", "_from").alias("_from"),
                    F.when(F.col("got").isNull(), F.col("_runs")).otherwise(F.concat("_runs", F.array(run))).alias("_runs"),
                    (F.col("_done") | F.col("stop").isNull() | (left == 0)).alias("_done")))


def mix(docs: DataFrame, sources: Column, id_col: str = "doc_id", text_col: str = "text",
        seed: int = SEED, keep_rows: bool = False) -> tuple[DataFrame, dict, dict]:
    """(rows, sizes, targets): rows have id, ``_pattern``, ``size``, ``taken`` (tokens, repeats counted).

    ``sources`` is an array column, the sources a document belongs to (null is
    a source of its own).  With ``keep_rows`` the columns of ``docs`` stay.
    """
    spark = docs.sparkSession
    rows = docs.withColumns({
        "_pattern": F.array_sort(F.array_distinct(F.transform(sources, lambda s: s.cast("string")))),
        "_size": n_words(text_or_empty(text_col)),
        "_key": F.struct(F.xxhash64(F.lit(seed), F.col(id_col)).alias("h"),
                         F.xxhash64(text_or_empty(text_col)).alias("t"))})
    rows = rows.withColumn("_bucket", F.pmod(F.shiftrightunsigned(F.col("_key.h"), 40), F.lit(BUCKETS)))
    # The bucket leads the order, so that sums per bucket place the cut.
    rows = rows.withColumn("_key", F.struct(F.col("_bucket").alias("b"), F.col("_key.h").alias("h"),
                                            F.col("_key.t").alias("t")))
    narrow = materialize(rows.select(F.col(id_col).alias("_id"), "_pattern", "_size", "_key", "_bucket"),
                         "mix-sizes")
    by_bucket = narrow.groupBy("_pattern", "_bucket").agg(F.sum("_size").alias("tokens"))
    by_pattern = by_bucket.groupBy("_pattern").agg(F.sum("tokens").alias("tokens"))
    found = by_pattern.limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} combinations of sources")
    capacity = {tuple(r["_pattern"]): r["tokens"] for r in found}
    sizes: dict = defaultdict(int)
    for p, n in capacity.items():
        for s in p:
            sizes[s] += n
    targets = targets_for(dict(sizes))
    sent = min_cost_flow(capacity, targets)
    plan = [(list(p), *(divmod(sum(sent[p].values()), n) if n else (0, 0))) for p, n in capacity.items()]
    plan_df = F.broadcast(spark.createDataFrame(plan, "_pp array<string>, _passes long, _rest long"))

    # The remainder of a pattern: documents in seeded order, each one taken if it
    # still fits.  A round takes, of the documents that could fit, all up to the
    # first that does not; the next round goes on behind it with what is left.
    key_type = narrow.schema["_key"].dataType.simpleString()
    marks = materialize(plan_df.where("_rest > 0").select(
        "_pp", F.col("_rest").alias("_open"), F.lit(None).cast(key_type).alias("_from"),
        F.expr(f"cast(array() as array<struct<after:{key_type},upto:{key_type},most:bigint>>)").alias("_runs"),
        F.lit(False).alias("_done")), "mix-cuts")
    while marks.where(~F.col("_done")).limit(1).count():
        marks = materialize(_one_round(narrow, marks), "mix-cuts")
    # Last, the document not yet taken that comes nearest to what is left (repeated rows are taken together).
    off = F.abs(F.col("_open") - F.col("n"))
    best = (narrow.join(F.broadcast(marks), F.col("_pattern") == F.col("_pp"))
            .where((F.col("_size") > 0) & (F.col("_size") < 2 * F.col("_open")) & ~_taken(F.col("_runs")))
            .groupBy("_pp", "_key", "_open").agg(F.sum("_size").alias("n")).where(off < F.col("_open"))
            .groupBy("_pp").agg(F.min(F.struct(off.alias("off"), F.col("_key").alias("k"))).alias("best")))
    marks = marks.join(F.broadcast(best), "_pp", "left").select("_pp", "_runs", F.col("best.k").alias("_last"))
    marks = materialize(plan_df.select("_pp", "_passes").join(marks, "_pp", "left"), "mix-cuts")

    base = (rows.drop("_bucket") if keep_rows else
            narrow.select(F.col("_id").alias(id_col), "_pattern", "_size", "_key"))
    once_more = F.coalesce(_taken(F.col("_runs")), F.lit(False)) | F.col("_key").eqNullSafe(F.col("_last"))
    out = (base.join(F.broadcast(marks), F.col("_pattern") == F.col("_pp"), "left")
           .withColumn("_times", F.coalesce(F.col("_passes"), F.lit(0)) + once_more.cast("long"))
           .drop("_pp", "_passes", "_runs", "_last", "_key"))
    return out, dict(sizes), targets


def mix_by_source(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id",
                  text_col: str = "text", seed: int = SEED) -> DataFrame:
    """The digest of a mix with one source per document: doc_id, size, source_size, target, taken."""
    out, sizes, targets = mix(docs, F.array(F.col(source_col)), id_col, text_col, seed)
    per = docs.sparkSession.createDataFrame([(s, sizes[s], targets[s]) for s in sizes],
                                            "_s string, source_size long, target double")
    return (out.join(F.broadcast(per), F.col("_pattern")[0].eqNullSafe(F.col("_s")), "left")
            .select(id_col, F.col("_size").alias("size"), "source_size", "target",
                    (F.col("_times") * F.col("_size")).alias("taken")))


def mixed_documents(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id",
                    text_col: str = "text", seed: int = SEED) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``."""
    out, _, _ = mix(docs, F.array(F.col(source_col)), id_col, text_col, seed, keep_rows=True)
    return (out.where(F.col("_times") > 0)
            .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))))
            .select(*docs.columns))
