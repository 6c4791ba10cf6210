"""Line, suffix, chunk and Jaccard deduplication against plain versions, on rows with every odd case."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from . import brute
from .conftest import prose
from flockwatch.llm import chunkdedup, graph, jaccard, linededup, suffixdedup
from flockwatch.llm import queries as Q


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def line_digest(df):
    return linededup.dedup_lines(df).select("doc_id", "n_lines", "n_dropped",
                                            F.sha2(F.col("kept").cast("binary"), 256))


def test_lines(docs, corpus):
    assert rows_of(line_digest(docs)) == sorted(brute.lines(corpus), key=repr)


def test_lines_many_shards_and_copies(docs, corpus, monkeypatch):
    monkeypatch.setattr(linededup, "SHARD_KEYS", 3)
    monkeypatch.setattr(linededup, "COPY_PROBES", 4)
    assert rows_of(line_digest(docs)) == sorted(brute.lines(corpus), key=repr)


def test_lines_of_a_very_long_document(spark):
    """Work in proportion to the lines: 100,000 lines of which every other one goes."""
    shared = [f"a line of both documents {i}" for i in range(50_000)]
    text = "\n".join(x for i, line in enumerate(shared) for x in (line, f"only here, line {i}"))
    rows = [(1, "\n".join(shared)), (2, text)]
    got = rows_of(line_digest(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == sorted(brute.lines(rows), key=repr)
    assert [r[1:3] for r in got] == [(50_000, 0), (100_000, 50_000)]


@pytest.mark.parametrize("n", [1, 2, 3, 50, 5000])
def test_perfect_hash_is_minimal_and_perfect(n):
    h = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64))
    slots = linededup.look_up(h, linededup.build_perfect_hash(h), len(h))
    assert sorted(slots) == list(range(len(h)))


def repeat_digest(df):
    return suffixdedup.remove_repeats(df).select("doc_id", "n_bytes", *suffixdedup.digest(), "kept_sha256")


def test_repeats(docs, corpus):
    assert rows_of(repeat_digest(docs)) == sorted(brute.repeats(corpus), key=repr)


def test_repeats_split_large_groups(docs, corpus, monkeypatch):
    monkeypatch.setattr(suffixdedup, "HOT_CONTEXTS", 3)
    monkeypatch.setattr(suffixdedup, "BATCH_BYTES", 2000)
    monkeypatch.setattr(suffixdedup, "PIECE", 1000)
    assert rows_of(repeat_digest(docs)) == sorted(brute.repeats(corpus), key=repr)


def test_suffix_array_is_sorted():
    rng = random.Random(1)
    for letters in (b"ab\x00", b"abcd\xff", b"a"):
        for _ in range(40):
            t = bytes(rng.choice(letters) for _ in range(rng.randint(1, 60)))
            got = suffixdedup.suffix_array(np.frombuffer(t, np.uint8), 200)
            assert list(got) == sorted(range(len(t)), key=lambda i, t=t: t[i:])


def test_jaccard(docs, corpus):
    got = jaccard.linked_components(docs).select("doc_id", "n_shingles", "component_id")
    assert rows_of(got) == sorted(brute.jaccard(corpus), key=repr)


def test_jaccard_centres_and_families(docs, corpus, monkeypatch):
    monkeypatch.setattr(jaccard, "SPLIT", 1)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "CENTRED", 2)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    got = jaccard.linked_components(docs).select("doc_id", "n_shingles", "component_id")
    assert rows_of(got) == sorted(brute.jaccard(corpus), key=repr)


@pytest.mark.parametrize("n", [600, 1200])
def test_jaccard_edges_of_a_family_grow_with_its_size(spark, monkeypatch, n):
    rng = np.random.default_rng(n)
    body = [f"w{x}" for x in rng.integers(0, 5000, 150)]
    rows = []
    for i in range(n):
        words = list(body)
        words[rng.integers(0, 150)] = f"x{i}"
        rows.append((i, " ".join(words)))
    asked = []

    def counted(edges):
        asked.append(edges.count())
        return graph.components(edges)

    monkeypatch.setattr(jaccard, "components", counted)
    got = jaccard.linked_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert got.select("component_id").distinct().collect() == [(0,)]
    assert asked[-1] < n            # known components come as stars
    assert max(asked) <= 6 * n      # every document may link with a few centres


def test_jaccard_passage_in_many_documents_is_not_compared_in_pairs(spark, monkeypatch):
    # Documents that share a passage and hold much of their own cannot link; every two of them used to meet.
    n, rng = 160, np.random.default_rng(5)
    passage = [f"p{x}" for x in range(90)]
    rows = [(i, " ".join(passage + [f"w{i}x{j}" for j in range(60)])) for i in range(n)]
    rows += [(n + i, " ".join([*passage, f"y{i}", *(f"z{j}" for j in range(20))])) for i in range(4)]
    rng.shuffle(rows)
    rows = [(int(i), t) for i, t in rows]
    met = []

    def counted(rows):
        met.append(rows.count())
        return block_links(rows)

    block_links = jaccard._block_links
    monkeypatch.setattr(jaccard, "_block_links", counted)
    monkeypatch.setattr(jaccard, "SPLIT", 1)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "SLOT", 500)
    got = jaccard.linked_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert rows_of(got.select("doc_id", "n_shingles", "component_id")) == sorted(brute.jaccard(rows), key=repr)
    assert met and max(met) < n


def test_private_shingles_of_families(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, i % 3, sorted(set(rng.integers(-2**63, 2**63, 30).tolist() + rng.choice(1 << 40, 20).tolist()
                                  + list(range(i % 7, 40))))) for i in range(90)]
    held = collections.Counter((f, x) for _, f, s in rows for x in s)
    want = {i: k for i, f, s in rows if (k := sum(held[f, x] == 1 for x in s))}
    for slot in (1 << 20, 100):
        monkeypatch.setattr(jaccard, "SLOT", slot)
        members = spark.createDataFrame(rows, "node long, family long, s array<long>").repartition(3)
        assert {r["node"]: r["own"] for r in jaccard.private_shingles(members).collect()} == want


def test_private_shingles_are_folded_in_pieces(monkeypatch):
    monkeypatch.setattr(jaccard, "SLOT", 5)
    places = jaccard._Private()
    for node, s in ((1, [1, 2, 3]), (2, [3, 4, 9]), (3, [1, 5]), (4, [4, 6, 7, 8])):
        places.add(node, np.array(s))
    found = {n: k for b in places.end() for n, k in zip(*(c.to_pylist() for c in b.columns), strict=True)}
    assert found == {1: 1, 2: 1, 3: 1, 4: 3}


@pytest.mark.parametrize("n", [*range(4, 60), 90, 200, 700])
def test_linked_sets_share_enough_keys(n):
    """Pigeonhole: sets at the threshold share a key, and as many as the count asks for."""
    rng = np.random.default_rng(n)
    bands = jaccard.Bands()
    for _ in range(6):
        pool = np.unique(rng.integers(0, 1 << 62, 3 * n + 10).astype(np.uint64))
        rng.shuffle(pool)
        m = int(rng.integers(n, n * 5 // 4 + 1))
        overlap = -(-4 * (n + m) // 9)
        if overlap > n:
            continue
        a, b = pool[:n], np.concatenate((pool[:overlap], pool[n:n + m - overlap]))
        for salt in (0, 1):
            ka, ia = jaccard.index_keys(np.sort(a), bands, salt)
            kb, ib = jaccard.index_keys(np.sort(b), bands, salt)
            if n == m == overlap:
                continue
            common = set(ka.tolist()) & set(kb.tolist())
            assert common
            for band in {int(x) & 255 for x in ia} & {int(x) & 255 for x in ib}:
                ua = [(int(x) >> 8) & 0x7FFFFF for x in ia if int(x) & 255 == band][0]
                ub = [(int(x) >> 8) & 0x7FFFFF for x in ib if int(x) & 255 == band][0]
                shared = len({k for k, x in zip(ka.tolist(), ia.tolist(), strict=True) if x & 255 == band}
                             & {k for k, x in zip(kb.tolist(), ib.tolist(), strict=True) if x & 255 == band})
                assert shared >= max(ua, ub) - (n + m - 2 * overlap)


def test_one_per_group_keeps_the_smallest(docs, corpus):
    kept = [(r["doc_id"], r["text"]) for r in jaccard.one_per_group(docs).collect()]
    sets = [brute.shingles(t) for _, t in kept]
    linked = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b]
              and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    # A chain may leave two kept documents that link with a third only; kept ones are of different groups.
    assert not linked
    names = {c for _, n, c in brute.jaccard(corpus) if n and c is not None}
    assert names <= {i for i, _ in kept}
    assert sum(1 for _, t in kept if not (t or "").strip(brute.SPACE)) == 4


def test_chunks_resist_insertions():
    rng = np.random.default_rng(3)
    body = rng.integers(32, 127, 5000).astype(np.uint8)
    moved = np.concatenate((body[:1000], np.frombuffer(b"inserted", np.uint8), body[1000:]))
    chunks = [{x[a:b].tobytes() for a, b in zip(c[:-1], c[1:], strict=True)}
              for x in (body, moved) for c in [chunkdedup.cuts(x)]]
    assert len(chunks[0] - chunks[1]) <= 3
    sizes = np.diff(chunkdedup.cuts(body))
    assert sizes[1:-1].min() > chunkdedup.WIDTH


def chunks_of(b):
    at = chunkdedup.cuts(np.frombuffer(b, np.uint8)).tolist()
    return [b[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]


@pytest.mark.parametrize("unit", [b"-", b"ab", b"word ", b"a line of just thirty letters\n", b"=" * 31 + b"\n"])
def test_chunks_of_periodic_stretches(unit):
    rng = random.Random(6)
    one, two = (prose(rng, 40).encode() + unit * (n // len(unit)) + prose(rng, 40).encode() for n in (6000, 4500))
    a, b = chunks_of(one), chunks_of(two)
    assert max(map(len, a + b)) <= chunkdedup.LONGEST and min(map(len, (a + b)[1:-1])) >= chunkdedup.WIDTH
    assert sum(len(x) for x in b if x in set(a)) > 4000
    assert len(set(a)) < len(a) / 2


def test_long_pieces_are_cut_inside(monkeypatch):
    monkeypatch.setattr(chunkdedup, "LONGEST", 3 * chunkdedup.WIDTH)
    body = np.random.default_rng(4).integers(32, 127, 20_000).astype(np.uint8).tobytes()
    sizes = [len(x) for x in chunks_of(body)]
    assert sum(sizes) == len(body) and max(sizes[1:-1]) <= 3 * chunkdedup.WIDTH and min(sizes[1:-1]) > chunkdedup.WIDTH
    assert len(set(chunks_of(body)) - set(chunks_of(b"inserted" + body))) <= 3


def test_every_planted_passage_is_hit():
    rng = random.Random(12)
    for _ in range(800):
        passage = prose(rng, 51)[:313]
        one, two = (chunks_of((prose(rng, 40) + " " + passage + " " + prose(rng, 40)).encode()) for _ in range(2))
        known, at, later = set(one), 0, []
        for x in two:
            if x in known:
                later.append((at, len(x)))
            at += len(x)
        starts, sizes = (np.array(c, np.int64) for c in zip(*later, strict=True))
        assert chunkdedup.removed_runs(starts, sizes)


def test_short_copies_go_whole(spark):
    rows = [(1, "A short text."), (2, "A short text."), (3, "Another one."), (4, "A short text. And more of it.")]
    got = {r["doc_id"]: len(r["spans"]) for r in chunkdedup.remove_chunks(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 0}


def test_chunks(docs, corpus):
    import hashlib
    first, parts = {}, []
    for i, t in corpus:
        b = (t or "").encode()
        c = chunkdedup.cuts(np.frombuffer(b, np.uint8)).tolist()
        parts.append([(a, e, b[a:e]) for a, e in zip(c[:-1], c[1:], strict=True)])
        for a, _, x in parts[-1]:
            at = (i is not None, i or 0, a)
            first[x] = min(first.get(x, at), at)
    got = {}
    for r in chunkdedup.remove_chunks(docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for (i, t), p in zip(corpus, parts, strict=True):
        if i is None or [j for j, _ in corpus].count(i) > 1:
            continue
        later = [(a, e) for a, e, x in p if first[x] != (True, i, a)]
        runs = chunkdedup.removed_runs(np.array([a for a, _ in later], int), np.array([e - a for a, e in later], int))
        r = got[i][0]
        kept = chunkdedup.kept_bytes((t or "").encode(), runs)
        assert (r["n_chunks"], r["n_repeated"], r["kept_sha256"]) == (len(p), len(later), hashlib.sha256(kept).hexdigest())
    holders = [i for i, t in corpus if i is not None and 40 <= i < 60]
    assert sum(bool(got[i][0]["spans"]) for i in holders) >= len(holders) - 1


def test_empty_table(empty):
    assert line_digest(empty).count() == 0
    assert repeat_digest(empty).count() == 0
    assert jaccard.linked_components(empty).count() == 0
    assert jaccard.one_per_group(empty).count() == 0
    assert chunkdedup.remove_chunks(empty).count() == 0


def test_queries_read_every_row(spark):
    from conftest import SF_SMALL
    n = spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    for name in ("op2_line_dedup", "op9_substring_dedup"):
        assert Q.QUERIES[name](spark, SF_SMALL).count() == n
