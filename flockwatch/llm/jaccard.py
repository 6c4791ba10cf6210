"""Exact n-gram Jaccard join: partitioned universe, pigeonhole, one-deletion neighbourhoods.

Documents are sets of five-word shingles; two link when their Jaccard
similarity is at least 0.8, so their sets differ in at most ``H`` shingles,
with ``H`` a function of their sizes.  The universe of shingles is hashed into
``m`` segments (``m`` by size band).  Every document indexes, per segment, the
subset of its shingles that falls there.  Segments count credits: a segment
matched exactly counts one, one whose one-deletion neighbourhood is indexed
too counts two, an empty one none.  When the credits of either document exceed
``H``, pigeonhole says that a linked pair shares a key; with ``U`` exact
segments in use, at least ``U - H``.  Bands choose between the two by cost
(``allocate``): long documents take exact segments, short ones few segments
with deletions.  A document whose empty segments leave too few credits indexes
itself again under another hash of the universe, and in the end under each of
its shingles, so no pair is lost.

Pairs inside a large group of one key are not listed.  Its documents are
verified against one centre of the group, and links found so join components.
Then pairs across components are counted by shared keys, and those with enough
are verified.  Keys whose groups would still list many pairs are left out of
the counts: a linked pair either has half of the keys it must share elsewhere,
or shares more than half of them among such keys.  Documents with so many of
them form families, by a prefix of these keys, rarest first.  A member with
too many shingles that no other member has links with none and leaves.
Members of a family with an equal smallest shingle hash are compared in blocks.  Families
that still hold several components are dealt in blocks of which every two
meet, save blocks of one component.  A task intersects all sets of its blocks
at once, and only a spanning forest between components leaves it.

Copies (equal sets) are one node from the start.  Sets are compared by 64-bit
hashes of their shingles.

Defined cases: null or blank texts have empty sets and link with nothing;
fewer than five words form one shingle; repeated rows are copies; null ids
join components but never name them unless no other id is there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flockwatch.llm.common import SPACES, join_on_row_key, text_or_empty, with_row_key
from flockwatch.llm.graph import components, local_roots
from flockwatch.session import materialize

SHINGLE = 5
NUM, DEN = 4, 5             # threshold 4/5
RATIO = 1.6                 # of neighbouring band bounds; above DEN / NUM
SEEDS = 6                   # universes tried before a document is indexed by every shingle
CENTRED = 8                 # documents in a group above which centres come first
SPLIT = 2048                # pairs across components in a group above which its documents are compared in blocks
BLOCK = 256                 # documents of a block
KEY_ROWS = 50_000           # index rows of an Arrow batch; the JVM keeps the buffers of its largest batches
SLOT = 1 << 20              # shingles of a family that are counted in one place
BROADCAST_ROWS = 200_000

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(SHINGLE)], np.uint64)
_BASE = 0x5851F42D4C957F2D
_SPACE = np.isin(np.arange(256), list(SPACES.encode()))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * _M1
        x = (x ^ (x >> np.uint64(33))) * _M2
        return x ^ (x >> np.uint64(33))


_BYTES = mix64(np.arange(256, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))


class _Powers:
    """Powers of the base and of its inverse, grown when a longer text comes."""

    up = down = np.zeros(0, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 16)
            with np.errstate(over="ignore"):
                cls.up = np.multiply.accumulate(np.full(size, _BASE, np.uint64))
                cls.down = np.multiply.accumulate(np.full(size, pow(_BASE, -1, 1 << 64), np.uint64))
        return cls.up[:n], cls.down[:n]


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words, from running sums over the bytes."""
    body = np.frombuffer(text.lower(), np.uint8)        # bytes.lower() changes A-Z alone
    inside = np.concatenate(([False], ~_SPACE[body], [False]))
    turn = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = turn[::2], turn[1::2]
    up, down = _Powers.of(len(body) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[body] * up[:-1], dtype=np.uint64)))
        return mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted hashes of the distinct five-word shingles."""
    h = word_hashes(text)
    n = len(h)
    if n == 0:
        return h
    with np.errstate(over="ignore"):
        if n < SHINGLE:
            return mix64(np.array([(h * _POWERS[:n]).sum() + np.uint64(n)], np.uint64))
        k = n - SHINGLE + 1
        s = h[:k] * _POWERS[0]
        for i in range(1, SHINGLE):
            s += h[i:i + k] * _POWERS[i]
    s = np.sort(mix64(s))
    return s[np.concatenate(([True], s[1:] != s[:-1]))]


def most_different(n: int) -> int:
    """Largest symmetric difference of a set of n shingles and a linked one that is not smaller."""
    best = 0
    for r in range(n, n * DEN // NUM + 1):
        overlap = -(-NUM * (n + r) // (NUM + DEN))
        if overlap <= n:
            best = max(best, n + r - 2 * overlap)
    return best


def allocate(low: int, high: int) -> tuple[int, bool]:
    """(segments, deletions) of a band of sizes low..high: the cheaper way to more than H credits.

    Cost: index rows, and accidental matches, which grow as segments get small.
    """
    h, n = most_different(high), (low + high) / 2
    ways = []
    for deletions in (False, True):
        m = h // 2 + 1 if deletions else h + 1 + -(-h // 7)
        held = n / m - deletions
        ways.append((m + deletions * n + 16 * m * np.exp(-held), m, deletions))
    return min(ways)[1:]


class Bands:
    """Size bands, made as sizes ask for them."""

    def __init__(self):
        self.bounds, self.alloc = [4], []

    def of(self, n: int) -> int:
        while self.bounds[-1] <= n:
            low = self.bounds[-1]
            high = max(int(low * RATIO), low + 4)
            self.alloc.append(allocate(low, high - 1))
            self.bounds.append(high)
        return int(np.searchsorted(self.bounds, n, side="right")) - 1


def index_keys(s: np.ndarray, bands: Bands, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(key, info) of a set: under its own band, and under the one below if a linked set may be there.

    ``info`` packs size, exact segments in use (0 where shared keys cannot be
    counted on) and band.
    """
    n = len(s)
    if n < bands.bounds[0]:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)    # H is 0: links are copies
    own = bands.of(n)
    keys, infos = [], []
    for band in (own, own - 1):
        if band < 0 or band < own and -(-n * NUM // DEN) >= bands.bounds[own]:
            continue
        # A smaller partner of the lower band bounds H there.
        need = most_different(min(n, bands.bounds[band + 1] - 1)) + 1
        m, deletions = bands.alloc[band]
        made, used = [], 0
        for seed in range(SEEDS + 1):
            tag = np.uint64((band << 16) + (salt << 8) + seed + 1)
            with np.errstate(over="ignore"):
                x = mix64(s + tag * np.uint64(0x9E3779B97F4A7C15))
                if seed == SEEDS:
                    made.append(x)          # every shingle a key: no linked pair can be without one
                    break
                seg = ((x >> np.uint64(40)) % np.uint64(m)).astype(np.uint32)
                order = np.argsort(seg, kind="stable")
                seg, x = seg[order], mix64(x[order])
                first = np.concatenate(([0], np.flatnonzero(seg[1:] != seg[:-1]) + 1))
                total = np.add.reduceat(x, first)
                count = np.diff(np.append(first, n))
                place = mix64(seg[first] + (tag << np.uint64(32)))
                made.append(mix64(total + place))
                if deletions:
                    many = np.repeat(count > 1, count)
                    made.append(mix64(np.repeat(total + place, count) - x)[many])
                    credits = np.minimum(count, 2).sum()
                else:
                    credits = len(first)
            if credits >= need:
                used = 0 if deletions or seed else credits
                break
        made = np.concatenate(made)
        keys.append(made)
        infos.append(np.full(len(made), (n << 32) | (min(int(used), (1 << 23) - 1) << 8) | band, np.int64))
    return np.concatenate(keys), np.concatenate(infos)


def _texts(column: pa.Array) -> Iterator[bytes]:
    for v in column.cast(pa.large_binary()):
        yield v.as_py() or b""


def _node(s: np.ndarray) -> int:
    """Identity of a set: a hash of its sorted shingles."""
    if len(s) == 0:
        return 0
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def shingle_nodes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, _th, n, node) per document; node is null for an empty set."""
    def run(batches):
        for b in batches:
            sets = [shingle_set(t) for t in _texts(b.column(2))]
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([_node(s) if len(s) else None for s in sets], pa.int64())], names)

    names = [id_col, "_th", "n", "node"]
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, "_th", text_or_empty(text_col).alias("_t")).mapInArrow(
        run, f"`{id_col}` {kind}, _th long, n long, node long")


def key_rows(docs: DataFrame, text_col: str) -> DataFrame:
    """(key, node, info): the index; copies within a task emit once."""
    def run(batches):
        bands, seen = Bands(), set()
        for b in batches:
            keys, nodes, infos, held = [], [], [], 0
            for t in _texts(b.column(0)):
                s = shingle_set(t)
                node = _node(s)
                if len(s) == 0 or node in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(node)
                k, info = index_keys(s, bands)
                keys.append(k)
                nodes.append(np.full(len(k), node, np.int64))
                infos.append(info)
                held += len(k)
                if held > KEY_ROWS:
                    yield _batch(keys, nodes, infos)
                    keys, nodes, infos, held = [], [], [], 0
            if held:
                yield _batch(keys, nodes, infos)

    return docs.select(text_or_empty(text_col).alias("_t")).mapInArrow(run, "key long, node long, info long")


def _batch(keys, nodes, infos) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes)),
                                       pa.array(np.concatenate(infos))], ["key", "node", "info"])


def shingle_arrays(texts: DataFrame) -> DataFrame:
    """(node, s): the shingle hashes of the texts (node, _t)."""
    def run(batches):
        for b in batches:
            sets = [shingle_set(t).view(np.int64) for t in _texts(b.column(1))]
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                                             ["node", "s"])

    return texts.select("node", "_t").mapInArrow(run, "node long, s array<long>")


def _linked(n: Column, m: Column, common: Column) -> Column:
    return DEN * common >= NUM * (n + m - common)


def _size(info: str) -> Column:
    return F.shiftright(F.col(info), 32)


def _used(info: str) -> Column:
    return F.shiftright(F.col(info), 8).bitwiseAND(F.lit((1 << 23) - 1))


def _band(info: str) -> Column:
    return F.col(info).bitwiseAND(F.lit(255))


def _may_link(i: str, j: str) -> Column:
    return (DEN * _size(i) >= NUM * _size(j)) & (DEN * _size(j) >= NUM * _size(i))


def least_shared(i: str, j: str) -> Column:
    """Keys of one band that a linked pair shares at least: segments in use, less the largest difference."""
    total = _size(i) + _size(j)
    differ = total - 2 * F.ceil(NUM * total / (NUM + DEN))
    return F.greatest(F.lit(1), F.greatest(_used(i), _used(j)) - differ)


class _Verifier:
    """Verifies pairs of nodes by their whole sets; a node's text comes from one of its documents."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str):
        self.docs = docs.select(id_col, "_th", text_or_empty(text_col).alias("_t"))
        self.nodes, self.id_col = nodes, id_col

    def sets(self, wanted: DataFrame) -> DataFrame:
        """(node, s) of the wanted nodes."""
        reps = materialize(self.nodes.join(wanted, "node", "left_semi")
                           .groupBy("node").agg(F.min(F.struct(self.id_col, "_th")).alias("r"))
                           .select("node", f"r.{self.id_col}", "r._th"), "jaccard-reps")
        small = reps.count() <= BROADCAST_ROWS
        texts = join_on_row_key(self.docs, F.broadcast(reps) if small else reps, self.id_col, "inner")
        # Repeated rows give a node more than once.
        return materialize(shingle_arrays(texts), "jaccard-sets").dropDuplicates(["node"])

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link."""
        sets = self.sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
        right = sets.select(F.col("node").alias("b"), F.col("s").alias("sb"))
        left = sets.select(F.col("node").alias("a"), F.col("s").alias("sa"))
        common = F.size(F.array_intersect("sa", "sb"))
        return materialize(pairs.join(right, "b").join(left, "a")
                           .where(_linked(F.size("sa"), F.size("sb"), common)).select("a", "b"), "jaccard-links")


def _skipped_counts(hot: DataFrame) -> DataFrame:
    """(node, band, hot, t): keys of large groups of a node, and how many of them a pair must share to be left to families."""
    counts = (hot.groupBy("node", _band("info").alias("band"))
              .agg(F.count(F.lit(1)).alias("hot"), F.max("info").alias("info")))
    # A partner's difference is at most a quarter of the size, so linked pairs share this much at least.
    shared = F.greatest(F.lit(1), _used("info") - F.floor(_size("info") / 4))
    return counts.select("node", "band", "hot", (F.floor(shared / 2) + 1).alias("t"))


def _counted_pairs(rows: DataFrame, skipped: DataFrame) -> DataFrame:
    """Pairs (a, b) across components that share as many keys of a band as linked pairs must outside large groups."""
    rows = (rows.withColumn("band", _band("info")).join(skipped.select("node", "band", "hot"), ["node", "band"], "left")
            .withColumn("hot", F.coalesce("hot", F.lit(0))))
    other = rows.select("key", F.col("node").alias("_c"), F.col("info").alias("_i"), F.col("comp").alias("_comp"),
                        F.col("hot").alias("_hot"))
    near = (rows.join(other, "key")
            .where((F.col("node") < F.col("_c")) & (F.col("comp") != F.col("_comp")) & _may_link("info", "_i")))
    need = least_shared("ia", "ib")
    return (near.groupBy(F.col("node").alias("a"), F.col("_c").alias("b"), "band")
            .agg(F.count(F.lit(1)).alias("k"), F.max("info").alias("ia"), F.max("_i").alias("ib"),
                 F.least(F.max("hot"), F.max("_hot")).alias("hot"))
            .where(F.col("k") >= need - F.least(F.col("hot"), F.floor(need / 2))).select("a", "b").distinct())


def forest(labels: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b) between labels that span the components of the links among the given sets; equal labels are one."""
    names, at = np.unique(labels, return_inverse=True)
    if len(names) == 1:
        return names[:0], names[:0]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = np.zeros((len(sets), len(sets)), np.float32)
    shared = times[column] > 1
    owner, column = owner[shared], (np.cumsum(times > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        i, j = np.searchsorted(column, (low, low + 4096))
        part = np.zeros((len(sets), 4096), np.float32)
        part[owner[i:j], column[i:j] - low] = 1
        common += part @ part.T
    n = np.array([len(s) for s in sets], np.int64)
    common = common.astype(np.int64)
    a, b = np.nonzero(np.triu(DEN * common >= NUM * (n[:, None] + n[None, :] - common), 1))
    root = local_roots(len(names), at[a], at[b])
    child = np.flatnonzero(root != np.arange(len(names)))
    return names[root[child]], names[child]


def _block_links(rows: DataFrame) -> DataFrame:
    """Forests (a, b) between the components of each place, from rows (place, comp, s)."""
    def run(batches):
        held, at = [], None
        for b in batches:
            places, comps, sets = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)
            for i, p in enumerate(places):
                if held and p != at:
                    yield solve(held)
                    held = []
                at = p
                held.append((comps[i], np.array(sets[i].values)))
        if held:
            yield solve(held)

    def solve(held):
        a, b = forest(np.array([x for x, _ in held], np.int64), [s for _, s in held])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    met = rows.select("place", "comp", "s").repartition("place").sortWithinPartitions("place")
    return materialize(met.mapInArrow(run, "a long, b long"), "jaccard-links")


def _families(hot: DataFrame, skipped: DataFrame) -> DataFrame:
    """(node, family): documents that may share enough keys of large groups with another one."""
    # Two documents that share t of these keys share one among their first hot - t + 1, in one order for all.
    common = hot.groupBy("key").agg(F.count(F.lit(1)).alias("m"))
    ranked = Window.partitionBy("node", "band").orderBy("m", "key")
    prefix = (hot.withColumn("band", _band("info"))
              .join(skipped.where(F.col("hot") >= F.col("t")), ["node", "band"]).join(common, "key")
              .withColumn("rank", F.row_number().over(ranked))
              .where(F.col("rank") <= F.col("hot") - F.col("t") + 1).select("key", "node"))
    prefix = materialize(prefix, "jaccard-prefix")
    least = (prefix.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most"))
             .where(F.col("least") < F.col("most")).select("key", "least"))
    shared = materialize(prefix.join(least, "key"), "jaccard-shared")
    # Every document starts at the smallest node it shares a key with, so few labels are left to be joined.
    labels = materialize(shared.groupBy("node").agg(F.min("least").alias("label")), "jaccard-labels")
    # The keys of a document tie their smallest nodes together.
    own = F.min("least").over(Window.partitionBy("node"))
    edges = (shared.select(own.alias("a"), F.col("least").alias("b")).where(F.col("a") < F.col("b")).distinct())
    comps = components(edges).withColumnRenamed("node", "label")
    return materialize(labels.join(comps, "label", "left")
                       .select("node", F.coalesce("comp", "label").alias("family")), "jaccard-families")


def _labelled(nodes: DataFrame, comps: DataFrame) -> DataFrame:
    """``nodes`` with ``comp``, themselves where no link is known."""
    known = comps.withColumnRenamed("node", "_node")
    return (nodes.join(known, F.col("node") == F.col("_node"), "left").drop("_node")
            .withColumn("comp", F.coalesce("comp", "node")))


def _spanning(groups: DataFrame, by: list[str]) -> DataFrame:
    """Sizes ``m`` of the groups of rows that hold several components."""
    return (groups.groupBy(*by).agg(F.count(F.lit(1)).alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
            .where(F.col("lo") < F.col("hi")).drop("lo", "hi"))


def _nearest_links(members: DataFrame, comps: DataFrame) -> DataFrame:
    """Links (a, b) among family members (node, family, s) with an equal smallest hash of their shingles.

    Linked sets have it in common four times in five.  Equal ones are compared
    in blocks, so this is linear in the members, and later comparisons start
    from the components it finds.
    """
    rows = _labelled(members.withColumn("low", F.array_min(F.transform("s", lambda x: F.xxhash64(x)))), comps)
    return _block_links(rows.join(_spanning(rows, ["family", "low"]), ["family", "low"])
                        .withColumn("block", F.pmod(F.xxhash64("node"), F.ceil(F.col("m") / BLOCK)))
                        .select(F.xxhash64("family", "low", "block").alias("place"), "comp", "s"))


def _joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components of what is known and of new links."""
    known = comps.where(F.col("node") != F.col("comp")).select(F.col("node").alias("a"), F.col("comp").alias("b"))
    return components(known.unionByName(links))


def _family_links(members: DataFrame, comps: DataFrame) -> DataFrame:
    """Links (a, b) that join all components of linked members (node, family, s): every two blocks of a family meet.

    Large components have blocks of their own, which do not meet each other.
    """
    rows = _labelled(members.select("node", "family"), comps)
    rows = rows.join(_spanning(rows, ["family"]).select("family"), "family")
    sizes = (rows.groupBy("family", "comp").agg(F.count(F.lit(1)).alias("m"))
             .withColumn("own", F.when(F.col("m") > BLOCK, F.col("comp"))))
    mixed = (sizes.where(F.col("own").isNull()).groupBy("family").agg(F.sum("m").alias("rest")))
    dealt = (rows.join(sizes, ["family", "comp"]).join(mixed, "family", "left")
             .withColumn("block", F.when(F.col("own").isNull(), F.pmod(F.xxhash64("comp"), F.ceil(F.col("rest") / BLOCK)))
                         .otherwise(F.pmod(F.xxhash64("node"), F.ceil(F.col("m") / BLOCK))))
             .withColumn("block", F.xxhash64("family", "own", "block")).select("family", "own", "block", "node", "comp"))
    dealt = materialize(dealt, "jaccard-dealt")
    blocks = dealt.select("family", "own", "block").distinct()
    other = blocks.select("family", F.col("own").alias("_own"), F.col("block").alias("other"))
    meet = (blocks.join(other, "family")
            .where((F.col("block") <= F.col("other")) & ~F.coalesce(F.col("own") == F.col("_own"), F.lit(False)))
            .withColumn("place", F.xxhash64("block", "other")))
    meet = meet.select("block", "place").union(meet.select("other", "place")).distinct()
    return _block_links(dealt.select("block", "node", "comp").join(meet, "block")
                        .join(members.select("node", "s"), "node"))


def _open_keys(groups: DataFrame, comps: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows (key, node, info, comp) of groups of several components; large groups' keys, their counts by node, their rows."""
    rows = _labelled(groups.select("key", "node", "info"), comps)
    open_ = materialize(rows.join(_spanning(rows, ["key"]).select("key"), "key"), "jaccard-open")
    sizes = open_.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m"))
    large = (sizes.groupBy("key").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("mm"))
             .where((F.col("m") * F.col("m") - F.col("mm")) / 2 > SPLIT).select("key"))
    large = materialize(large, "jaccard-large")
    hot = materialize(open_.join(large, "key"), "jaccard-hot")
    return open_, large, materialize(_skipped_counts(hot), "jaccard-skipped"), hot


def _members(hot: DataFrame, skipped: DataFrame, verifier: _Verifier) -> DataFrame:
    """(node, family, s) of the families' members that may link."""
    family = _families(hot, skipped)
    return _sharing(materialize(family.join(verifier.sets(family.select("node")), "node").select("node", "family", "s"),
                                "jaccard-members"))


def private_shingles(members: DataFrame) -> DataFrame:
    """(node, own): shingles that no other member (node, family, s) of the family has; nodes without any may be missing.

    A family's shingles are dealt by their hash into places of about ``SLOT``,
    so a large family is counted by many tasks.  A node is in one family.
    """
    def deal(batches):
        for b in batches:
            nodes, families, slots = (b.column(i).to_numpy() for i in range(3))
            out = []
            for i, s in enumerate(b.column(3)):
                s = np.array(s.values)
                at = (s.view(np.uint64) >> np.uint64(32)) % np.uint64(slots[i])
                s = s[np.argsort(at, kind="stable")]
                used, n = np.unique(at, return_counts=True)
                out += [(families[i], int(u), nodes[i], x) for u, x in zip(used, np.split(s, np.cumsum(n)[:-1]))]
                if len(out) >= 4096:
                    yield batch(out)
                    out = []
            if out:
                yield batch(out)

    def batch(out):
        family, slot, node, parts = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(family, pa.int64()), pa.array(slot, pa.int64()), pa.array(node, pa.int64()),
                                           pa.array(parts, pa.list_(pa.int64()))], ["family", "slot", "node", "s"])

    def count(batches):
        at, places = None, _Private()
        for b in batches:
            keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            for i, (node, s) in enumerate(zip(b.column(2).to_pylist(), b.column(3))):
                if keys[i] != at:
                    yield from places.end()
                    at, places = keys[i], _Private()
                places.add(node, np.array(s.values))
        yield from places.end()

    sizes = members.groupBy("family").agg(F.ceil(F.sum(F.size("s")) / SLOT).alias("slots"))
    dealt = (members.join(sizes, "family").select("node", "family", "slots", "s")
             .mapInArrow(deal, "family long, slot long, node long, s array<long>"))
    counted = (dealt.repartition("family", "slot").sortWithinPartitions("family", "slot")
               .mapInArrow(count, "node long, own long"))
    return counted.groupBy("node").agg(F.sum("own").alias("own"))


class _Private:
    """Distinct shingles of one place, each with its node, or with several."""

    def __init__(self):
        self.s, self.node, self.once = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.new, self.held = [], 0

    def add(self, node: int, s: np.ndarray) -> None:
        self.new.append((node, s))
        self.held += len(s)
        if self.held > SLOT:
            self._fold()

    def _fold(self) -> None:
        s = np.concatenate((self.s, *(x for _, x in self.new)))
        node = np.concatenate((self.node, *(np.full(len(x), n, np.int64) for n, x in self.new)))
        once = np.concatenate((self.once, np.ones(self.held, bool)))
        self.s, first, times = np.unique(s, return_index=True, return_counts=True)
        self.node, self.once = node[first], once[first] & (times == 1)
        self.new, self.held = [], 0

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self._fold()
        node, own = np.unique(self.node[self.once], return_counts=True)
        if len(node):
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(own.astype(np.int64))], ["node", "own"])


def _sharing(members: DataFrame) -> DataFrame:
    """The members (node, family, s) that share enough shingles with the rest of the family to link with any of it.

    A linked pair has 4/9 of both sizes in common.  Private shingles are never
    common, and the partner is as large as the family's smallest set at least,
    and as 4/5 of this one.
    """
    n, least = F.size("s"), members.groupBy("family").agg(F.min(F.size("s")).alias("least"))
    partner = F.greatest(F.col("least"), F.ceil(NUM * n / DEN))
    kept = (members.join(private_shingles(members), "node", "left").join(least, "family")
            .where((NUM + DEN) * (n - F.coalesce("own", F.lit(0))) >= NUM * (n + partner)))
    return materialize(kept.select("node", "family", "s"), "jaccard-members")


def linked_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``_th``, n_shingles, component_id (smallest id reachable by links), group.

    ``group`` identifies the component; it is null for empty sets.
    """
    docs = with_row_key(docs, id_col, text_col)
    nodes = materialize(shingle_nodes(docs, id_col, text_col), "jaccard-nodes")
    verifier = _Verifier(docs, nodes, id_col, text_col)

    whole = Window.partitionBy("key")
    keyed = (key_rows(docs, text_col)
             .withColumns({"lo": F.min("node").over(whole), "hi": F.max("node").over(whole)})
             .where(F.col("lo") < F.col("hi")).dropDuplicates(["key", "node"]).select("key", "node", "info"))
    groups = materialize(keyed, "jaccard-groups")

    # Centres only save work, so weak pairs can wait: some keys together, not one by chance.
    centre = F.min(F.struct("node", "info")).over(whole)
    near = (groups.withColumns({"c": centre, "m": F.count(F.lit(1)).over(whole)})
            .where((F.col("m") > CENTRED) & (F.col("node") != F.col("c.node")))
            .withColumn("_c", F.col("c.node")).withColumn("_i", F.col("c.info")).where(_may_link("info", "_i")))
    tested = materialize(near.groupBy(F.col("_c").alias("a"), F.col("node").alias("b")).count()
                         .where(F.col("count") > 2).select("a", "b"), "jaccard-pairs")
    comps = components(verifier.linked(tested))
    open_, large, skipped, hot = _open_keys(groups, comps)
    if not hot.isEmpty():
        members = _members(hot, skipped, verifier)
        comps = _joined(comps, _nearest_links(members, comps))
        comps = _joined(comps, _family_links(members, comps))
    rest = (_counted_pairs(open_.join(large, "key", "left_anti"), skipped)
            .join(tested, ["a", "b"], "left_anti"))
    comps = _joined(comps, verifier.linked(materialize(rest, "jaccard-pairs")))

    named = nodes.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    smallest = named.where(F.col("comp").isNotNull()).groupBy("comp").agg(F.min(id_col).alias("component_id"))
    return (named.join(smallest, "comp", "left")
            .select(id_col, "_th", F.col("n").alias("n_shingles"),
                    F.when(F.col("node").isNull(), F.col(id_col)).otherwise(F.col("component_id"))
                    .alias("component_id"), F.col("comp").alias("group")))


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each linked group: the smallest id (of repeated rows one)."""
    found = linked_components(docs, id_col, text_col).where(F.col("group").isNotNull())
    best = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("_th").alias("th")))
    kept = found.groupBy("group").agg(best.alias("k")).select(
        F.xxhash64("k.id", "k.th").alias("_krk"), F.col("k.th").alias("_kth"))
    keyed = with_row_key(docs, id_col, text_col).withColumn("_rk", F.xxhash64(id_col, "_th"))
    blank = F.length(F.btrim(text_or_empty(text_col), F.lit(SPACES))) == 0
    chosen = (keyed.join(kept, (F.col("_rk") == F.col("_krk")) & (F.col("_th") == F.col("_kth")))
              .withColumn("_n", F.row_number().over(Window.partitionBy("_rk", "_th").orderBy("_rk")))
              .where(F.col("_n") == 1))
    return chosen.select(*docs.columns).unionByName(docs.where(blank))
