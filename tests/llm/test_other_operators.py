"""Toxicity, sharding, token counts, decontamination, embeddings, mixing and the pipeline."""

import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from . import brute
from flockwatch.llm import decontaminate, mixing, neardup, sharding, tokencount, toxicity
from flockwatch.llm import queries as Q


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


# Toxicity -------------------------------------------------------------------

def test_toxicity_separates_held_out_documents(spark):
    from conftest import SF_CHECK
    got = {r["doc_id"]: r for r in Q.QUERIES["op1_toxicity"](spark, SF_CHECK).collect()}
    labels = spark.read.parquet(f"{SF_CHECK}/labels.parquet").collect()
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    test = [(r["toxic"], got[r["doc_id"]]["score"]) for r in labels if got[r["doc_id"]]["held_out"]]
    bad, good = [s for y, s in test if y], [s for y, s in test if not y]
    auc = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])
    assert auc > 0.8


def test_toxicity_ignores_held_out_labels_and_odd_rows(spark, docs, empty):
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(60)] + [(1, 0), (1, None), (None, 1)],
                                   "doc_id long, toxic int")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (rows_of(toxicity.toxicity(docs, x).select("doc_id", "score", "n")) for x in (labels, flipped))
    assert one == two and len(one) == docs.count()
    none = toxicity.toxicity(docs, labels.limit(0)).select("score", "predicted").distinct().collect()
    assert [tuple(r) for r in none] == [(0.0, 0)]
    assert toxicity.without_toxic(empty, labels).columns == empty.columns


# Sharding -------------------------------------------------------------------

def test_longest_first_onto_least_loaded():
    placed = sharding.lpt([(7, "a"), (6, "b"), (5, "c"), (4, "d"), (3, "e")], 2)
    assert placed == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 0}


@pytest.mark.parametrize("fine", [64, 1])
def test_shards(docs, corpus, empty, monkeypatch, fine):
    monkeypatch.setattr(sharding, "FINE", fine)
    out = sharding.shard_documents(docs, 4).collect()
    assert len(out) == len(corpus)
    shards, slots, load = defaultdict(set), defaultdict(list), Counter()
    for r in out:
        text = r["text"] or ""
        assert r["size"] == len(text.encode()) + 16 and r["text_crc32"] == zlib.crc32(text.encode())
        assert r["law"] == "bytes" and r["grown_shard"] is None and r["n"] == "own"
        shards[text].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
    assert all(len(s) == 1 for s in shards.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(len((t or "").encode()) + 16 for _, t in corpus)
    assert max(load.values()) - min(load.values()) <= largest
    assert sharding.shard_documents(empty, 4).count() == 0


# Token counts ---------------------------------------------------------------

@pytest.fixture(scope="module")
def counter():
    return tokencount.PieceCounter(tokencount.load_ranks())


def test_edits_recount_like_a_new_encoding(counter, corpus, monkeypatch):
    monkeypatch.setattr(tokencount, "LEAF", 4)
    rng = random.Random(3)
    bits = ["a", " ", "  ", "\n", " b", "'s", "1", "!!", "é"]
    for trial in range(1500):
        t = ((rng.choice(corpus)[1] or "")[:rng.randint(0, 500)] if trial % 2
             else "".join(rng.choice(bits) for _ in range(rng.randint(0, 60))))
        tree = tokencount.TokenTree(t, counter)
        for _ in range(rng.randint(1, 4)):
            a = rng.randint(0, len(t))
            b = rng.randint(a, min(len(t), a + 40))
            new = "".join(rng.choice(["", *bits]) for _ in range(rng.randint(0, 4)))
            tree.edit(a, b, new)
            t = t[:a] + new + t[b:]
            assert tree.text() == t
            assert tree.total == len(counter.encode(t))


def test_redactions_begin_where_a_plain_search_begins():
    plain = re.compile(r"(?P<mail>[\w.+-]+@[\w-]+\.[\w.-]*\w)|(?P<number>\d(?:[ -]?\d){6,})")
    rng = random.Random(5)
    for _ in range(20_000):
        t = "".join(rng.choice("ab1234@@.. -+é") for _ in range(rng.randint(0, 40)))
        assert tokencount.redactions(t) == [(m.start(), m.end(), f"<{m.lastgroup}>") for m in plain.finditer(t)]


def test_a_word_of_a_megabyte_is_counted_in_linear_time(counter):
    word = "".join(random.Random(6).choices("abcdefghij", k=1_000_000))
    assert tokencount.redactions(word) == [] and len(tokencount.redactions(word + "@b.org " + word)) == 1
    tree = tokencount.TokenTree(word + " x", counter)
    tree.edit(1_000_001, 1_000_002, "y")
    assert tree.total == len(counter.encode(word + " y"))


def test_recount(docs, empty, counter):
    for r in tokencount.recount(docs).collect():
        t = r["text"] or ""
        assert r["tokens_before"] == len(counter.encode(t)) and r["n"] == "own"
        edits = tokencount.redactions(t)
        for a, b, new in reversed(edits):
            t = t[:a] + new + t[b:]
        assert (r["n_edits"], r["tokens_after"]) == (len(edits), len(counter.encode(t)))
    assert tokencount.recount(empty).count() == 0


def test_trees_written_once_are_updated_by_edit_tables(spark, corpus, empty, counter, tmp_path):
    """Two updates, each from the written table before it, against new encodings of the edited texts."""
    rng = random.Random(12)
    # One very long text, so that what an update encodes can be held against what the tree holds.
    texts = {i: t or "" for i, t in corpus if i is not None and sum(j == i for j, _ in corpus) == 1}
    texts[10_001] = "some words here " * 5000
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    tokencount.tree_table(rows).write.parquet(str(tmp_path / "0"))
    first = {r.doc_id: r for r in spark.read.parquet(str(tmp_path / "0")).collect()}
    for step in range(2):
        edits = []
        for i, t in texts.items():
            at = 0
            for _ in range(rng.randint(0, 3)):
                a = rng.randint(at, len(t))
                b = min(len(t), a + rng.randint(0, 20))
                edits.append((i, a, b, rng.choice([None, "", "x", " new words", "\n\n", "1" * 9, " w" * 200])))
                at = b + 1
                if at > len(t):
                    break
        order = list({(i, a): (i, a, b, new) for i, a, b, new in edits}.values())
        table = spark.createDataFrame([*order, (None, 0, 0, "x"), (99_999, 0, 5, "x")],
                                      "doc_id long, start int, end int, replacement string")
        before = spark.read.parquet(str(tmp_path / str(step)))
        tokencount.update_trees(before, table).write.parquet(str(tmp_path / str(step + 1)))
        for i, a, b, new in sorted(order, reverse=True):
            texts[i] = texts[i][:a] + (new or "") + texts[i][b:]
        got = spark.read.parquet(str(tmp_path / str(step + 1))).collect()
        assert len(got) == len(texts)
        for r in got:
            mine = [e for e in order if e[0] == r.doc_id]
            assert "".join(leaf.text for leaf in r.leaves) == texts[r.doc_id]
            assert (r.n_tokens, r.n_edits) == (len(counter.encode(texts[r.doc_id])), len(mine))
            assert sum(leaf.tokens for leaf in r.leaves) == r.n_tokens
            assert all(len(leaf.ends) <= 2 * tokencount.LEAF for leaf in r.leaves)
            assert r.n_encoded == 0 if not mine else True
            if r.doc_id == 10_001:
                assert r.n_encoded < sum(len(leaf.ends) for leaf in first[10_001].leaves) / 10
    assert tokencount.update_trees(tokencount.tree_table(empty), table).count() == 0


@pytest.mark.parametrize("edits", [[(1, 0, 3, "x"), (1, 2, 4, "y")], [(1, 3, 99, "x")], [(1, None, 2, "x")]])
def test_edits_that_cannot_be_applied_fail(spark, edits):
    trees = tokencount.tree_table(spark.createDataFrame([(1, "some words")], "doc_id long, text string"))
    table = spark.createDataFrame(edits, "doc_id long, start int, end int, replacement string")
    with pytest.raises(Exception, match="disjoint"):
        tokencount.update_trees(trees, table).collect()


def test_edits_encode_little_of_a_long_text(counter):
    tree = tokencount.TokenTree("some words here " * 5000, counter)
    tree.edit(40_000, 40_004, "else")
    assert tree.encoded < 3 * tokencount.LEAF


# Decontamination ------------------------------------------------------------

ITEMS = [(1, None), (2, ""), (3, "..."), (4, "changed61"), (4, "changed62"), (5, "Short ONE"), (None, "mail a b")]


def _items(spark, corpus):
    long = corpus[45][1].split()
    rows = [*ITEMS, (7, " ".join(long[12:50])), (7, " ".join(long[12:50])), (8, " ".join(long[15:28]) + " other"),
            (9, " ".join(long[15:27])), (10, "aaaa " * 40), (11, corpus[0][1].upper())]
    return rows, spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_contamination(spark, docs, corpus, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", limit)
    rows, items = _items(spark, corpus)
    got = decontaminate.contamination(docs, items).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256), "contaminated")
    assert rows_of(got) == sorted(brute.contamination(corpus, rows), key=repr)


def test_decontaminated_keeps_clean_rows(spark, docs, corpus, empty):
    rows, items = _items(spark, corpus)
    clean = [(i, t) for (i, t), r in zip(corpus, brute.contamination(corpus, rows), strict=True) if not r[-1]]
    out = decontaminate.decontaminated(docs, items)
    assert out.columns == docs.columns
    assert rows_of(out.select("doc_id", "text")) == sorted(clean, key=repr)
    assert decontaminate.decontaminated(docs, items.limit(0)).count() == len(corpus)
    assert decontaminate.contamination(empty, items).count() == 0


def test_native_operator_runs_no_python(spark, docs, corpus):
    plan = decontaminate.contamination(docs, _items(spark, corpus)[1])._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


# Embeddings -----------------------------------------------------------------

def _vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 32))
    for i in range(200, 320):
        x[i] = x[i % 40] + 0.05 * rng.standard_normal(32)
    for i in range(320, 400):
        x[i] = x[199] + 0.04 * rng.standard_normal(32)
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    rows += [(500, None), (501, []), (502, [0.0] * 32), (503, [None] + [1.0] * 31), (504, [float("nan")] * 32),
             (505, [float("inf")] + [1.0] * 31), (506, rows[0][1]), (0, rows[0][1]), (None, rows[1][1]),
             (507, [2 * a for a in rows[2][1]]), (508, [1.0, 2.0]), (509, [1.0, 2.0]), (510, [1e300, 2e300])]
    return rows, spark.createDataFrame([(*r, "own") for r in rows], "vec_id long, embedding array<double>, n_links string")


def _vector_links(rows):
    def unit(v):
        ok = v and all(a is not None and np.isfinite(a) for a in v) and any(v)
        if not ok:
            return None
        v = np.array(v) / max(abs(a) for a in v)
        return v / np.sqrt(v @ v)

    u = [unit(v) for _, v in rows]
    return [(a, b) for a in range(len(u)) for b in range(a) if u[a] is not None and u[b] is not None
            and len(u[a]) == len(u[b]) and u[a] @ u[b] >= neardup.COSINE]


@pytest.mark.parametrize("block", [256, 7])
def test_embeddings(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows, table = _vectors(spark)
    pairs = _vector_links(rows)
    links = Counter(x for p in pairs for x in p)
    names = brute.components([i for i, _ in rows], pairs)
    want = [(i, links[k], names[k], names[k] is None or i == names[k]) for k, (i, _) in enumerate(rows)]
    got = rows_of(neardup.near_duplicates(table))
    found, there = sum(r[1] for r in got), 2 * len(pairs)
    assert 0.9 * there <= found <= there
    want = [w if w[0] is not None else (None, w[1], w[2], True) for w in want]
    assert [r for r in got if r[0] is not None] == sorted([w for w in want if w[0] is not None], key=repr)
    assert neardup.near_duplicates(table.limit(0)).count() == 0


def _around(rng, centre, cosine, n):
    """Unit vectors whose cosine with each other is ``cosine`` on average."""
    x = rng.standard_normal((n, len(centre)))
    x -= np.outer(x @ centre, centre)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return np.sqrt(cosine) * centre + np.sqrt(1 - cosine) * x


@pytest.mark.parametrize("shape", ["cone", "hot third"])
def test_embeddings_off_centre(spark, shape):
    rng = np.random.default_rng(7)
    centre = np.eye(64)[0]
    if shape == "cone":
        x = _around(rng, centre, 0.8, 2400)
    else:
        x = np.concatenate((_around(rng, centre, 0.93, 800), rng.standard_normal((1600, 64))))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x[:400] + 0.28 * (lambda y: y / np.linalg.norm(y, axis=1, keepdims=True))(rng.standard_normal((400, 64)))
    x = np.concatenate((x, near / np.linalg.norm(near, axis=1, keepdims=True)))
    there = int((np.triu(x @ x.T, 1) >= neardup.COSINE).sum())
    assert there >= 350
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = neardup.near_duplicates(table).agg(F.sum("n_links")).first()[0]
    assert 0.985 * there <= found / 2 <= there


# Mixing ---------------------------------------------------------------------

def test_targets_stop_at_three_times_the_source():
    t = mixing.targets_for({"a": 10, "b": 100, None: 890})
    assert t["a"] == 30 and t["b"] == 300 and abs(sum(t.values()) - 1000) < 1e-6 and t[None] == 670
    assert mixing.targets_for({"a": 0}) == {"a": 0.0}


def test_flow_repeats_only_where_a_quota_needs_it():
    sent = mixing.min_cost_flow({("a",): 10, ("a", "b"): 10, ("b",): 10}, {"a": 25, "b": 5})
    assert sent[("a",)]["a"] + sent[("a", "b")]["a"] == 25
    assert sent[("a", "b")]["b"] + sent[("b",)]["b"] == 5
    # b needs nothing of the shared documents; a takes them once before it repeats anything twice.
    assert sent[("b",)]["b"] == 5 and sent[("a", "b")]["a"] >= 10


def test_mix(docs, corpus, empty):
    got = mixing.mix_by_source(docs).collect()
    assert len(got) == len(corpus)
    per = defaultdict(list)
    for r in got:
        assert r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 3 * r["size"]
        per[r["target"], r["source_size"]].append(r)
    for (target, size), rows in per.items():
        assert sum(r["size"] for r in rows) % size == 0
        largest = max(r["size"] for r in rows)
        if len(rows) < 40:
            assert abs(sum(r["taken"] for r in rows) - target) <= largest
    again = mixing.mix_by_source(docs.repartition(3)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    copies = mixing.mixed_documents(docs)
    assert copies.columns == docs.columns
    taken = sum(r["taken"] for r in got)
    assert copies.agg(F.sum(mixing.n_words(F.col("text")))).first()[0] == taken
    assert mixing.mix_by_source(empty).count() == 0
    assert mixing.mixed_documents(empty).count() == 0


def test_mix_passes_over_very_long_documents(spark):
    rng = random.Random(8)
    long = [20_000] * 60 + [rng.randint(10, 30) for _ in range(2000)]
    rows = [(i, "w " * n, "b") for i, n in enumerate(long)] + [(5000 + i, "w " * 700, "a") for i in range(500)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mixing.mix_by_source(table).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert len(got) == 2
    for r in got:
        assert abs(r["taken"] - r["target"]) <= 30


# Pipeline -------------------------------------------------------------------

def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    from conftest import SF_SMALL
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns, rows = docs.columns, [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "decontamination", "mixing", "sharding"]
    outs = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF_SMALL).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        outs.append([tuple(r) for r in docs.select("doc_id", "text").collect()])
        if k < 4:
            assert docs.columns == columns
    assert set(outs[0]) <= set(rows) and len(outs[0]) >= 0.8 * len(rows)
    names = {c for _, n, c in brute.jaccard(outs[0])}
    assert {i for i, _ in outs[1]} == names and len(outs[1]) == len(names)
    items = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    clean = [x for x, r in zip(outs[1], brute.contamination(outs[1], items), strict=True) if not r[-1]]
    assert sorted(outs[2]) == sorted(clean)
    assert set(outs[3]) <= set(outs[2]) and sorted(outs[3]) == sorted(outs[4])
    whole = corpus_pipeline.run(spark, SF_SMALL)
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in whole.collect()) == sorted(
        (r["doc_id"], r["shard"], r["slot"]) for r in docs.collect())


def test_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline
    from conftest import SF_SMALL
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF_SMALL}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_toxicity_model_is_read_without_copies_of_its_state():
    # Copies of the state, as large as itself, made the peak of the pipeline's Python workers.
    model = toxicity.Ftrl()
    model.z[[5, 9, 70, 1 << 20, -1]] = 7.0, -5.5, 5.0, -9.0, 0.5
    tracemalloc.start()
    got = model.kept()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.tolist() == [5, 9, 1 << 20, len(model.z) - 1]
    assert peak < model.z.nbytes // 2
