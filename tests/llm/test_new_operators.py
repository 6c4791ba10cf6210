"""Conversation repair, hard negatives and byte-level BPE, against plain versions."""

import base64
import collections
import hashlib
import itertools
import random
import re
import zlib

import public_tokenizers
import pytest
import tiktoken

from flockwatch.llm import bpe, convrepair, hardneg
from flockwatch.llm import queries as Q

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
CONV = "conv_id long, turn long, role string, text string, n_chars long, first string, cost string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Conversation repair --------------------------------------------------------

def damaged(rows):
    out = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(c, t, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def plain_repair(rows):
    """One conversation's result by a walk over its rows with the best (cost, audit) per state."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, faults = set(), []
    for _, _, role, text in rows:
        marks = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not marks else "duplicate" if (role, text) in seen
                      else "truncated" if marks[-1] not in ".!?" else "")
        seen.add((role, text))

    def put_in(best):
        # States: "" (nothing yet), "s", "u", "a".
        for _ in range(3):
            for state, (cost, audit, lines) in list(best.items()):
                to, role = ("a", "assistant") if state == "u" else ("u", "user")
                new = (cost + 2, audit + "I", [*lines, role + ":"])
                if to not in best or new[:2] < best[to][:2]:
                    best[to] = new
        return best

    best = put_in({"": (0, "", [])})
    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        after = {}
        for state, (cost, audit, lines) in best.items():
            ways = [(state, 3, "D", [])]
            if fault in ("", "truncated"):
                cut, ini = int(fault == "truncated"), role[:1]
                if (ini == "s" and state == "") or (ini == "u" and state != "u") or (ini == "a" and state == "u"):
                    ways.append((ini, cut, "K", [f"{role}:{text}"]))
                for new in ("user", "assistant"):
                    if (new == "assistant") == (state == "u"):
                        ways.append((new[0], 2 + cut, "R", [f"{new}:{text}"]))
            for to, paid, letter, more in ways:
                new = (cost + paid, audit + letter, lines + more)
                if to not in after or new[:2] < after[to][:2]:
                    after[to] = new
        best = put_in(after)
    cost, audit, lines = min((best[s] for s in ("", "a") if s in best), key=lambda x: x[:2])
    roles = "".join(x[0] for x in lines)
    assert re.fullmatch("(s?(ua)+)?", roles)
    ini = [r[2][:1] for r in rows]
    turns = [r[1] for r in rows if r[1] is not None]
    count = collections.Counter(faults)
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count["blank"], count["duplicate"], count["truncated"],
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(ini)), cost, audit, sha("\n".join(lines)))


def plain_repairs(rows):
    groups = collections.defaultdict(list)
    for r in damaged(rows):
        groups[r[0]].append(r)
    return {c: plain_repair(groups[c]) if c in groups else (0,) * 6 + ("", sha("")) for c in {r[0] for r in rows}}


def turns():
    rng = random.Random(8)
    texts = ["Yes.", "No!", "And then", "  ", "", None, "why?\n", "a longer answer.\t", "é ok."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    rows = []
    for c in [*range(120), None]:
        n = rng.choice([1, 1, 2, 3, 5, 8, 13])
        for t in range(n):
            turn = None if rng.random() < 0.05 else rng.randint(0, n) if rng.random() < 0.2 else t
            rows.append((c, turn, ("user", "assistant")[t % 2] if rng.random() < 0.6 else rng.choice(roles),
                         rng.choice(texts) if rng.random() < 0.5 else f"Line {rng.random()}."))
    rows += [(500, 3, "user", "Same.")] * 40 + [(501, t, "user" if t % 3 else "assistant", f"Long talk {t}" + "." * (t % 2)) for t in range(400)]
    return rows + rows[:3]


@pytest.mark.parametrize("block", [4096, 5])
def test_repair_equals_plain_walk(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(convrepair, "BLOCK", block)
    rows = turns()
    table = spark.createDataFrame([(*r, 1, "own", "own") for r in rows], CONV).repartition(5)
    table.write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"))
           for r in Q.QUERIES["op11_conversation_repair"](spark, str(tmp_path)).collect()}
    assert got == plain_repairs(rows)


def test_repair_of_whole_table(spark):
    from conftest import SF_CHECK
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_CHECK}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: (r["cost"], r["audit"], r["repaired_sha256"])
           for r in Q.QUERIES["op11_conversation_repair"](spark, SF_CHECK).collect()}
    assert got == {c: x[5:] for c, x in plain_repairs(rows).items()}


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], CONV)
    fixed = convrepair.repair(convrepair.damage(empty))
    assert fixed.summary.collect() == fixed.rows.collect() == convrepair.digests(fixed.rows).collect() == []


def test_rules_compress_and_keep_the_matrices(spark):
    rng = random.Random(2)
    seqs = ["".join(rng.choice("uauaUAsxo") for _ in range(rng.randint(1, 40))) for _ in range(200)] + ["ua" * 50]
    rules = convrepair.learn_rules(spark.createDataFrame([(s, 1) for s in seqs], "seq string, n long"))
    with_rules, without = convrepair.Grammar(rules), convrepair.Grammar([])
    assert 0 < len(rules) <= convrepair.MAX_RULES
    assert sum(len(convrepair.compress(s, rules)) for s in seqs) < 0.6 * sum(map(len, seqs))
    for s in seqs:
        a, b = ([[e and (e[0], convrepair.flat(e[1])) for e in row] for row in g.evaluate(s)] for g in (with_rules, without))
        assert a == b


# Hard negatives -------------------------------------------------------------

def plain_negatives(rows, k=5):
    rows = sorted(set(rows))
    out = []
    for i, label, q, anchor in rows:
        if not anchor:
            continue
        score = [(-sum(x * y for x, y in zip(q, r[2], strict=False)), r[0], r[1]) for r in rows if r[0] != i]
        for u, p, same in sorted(s for s in score if s[2] == label)[:k]:
            fits = sorted((s, n) for s, n, other in score if other != label and 80 * -u <= 100 * -s <= 100 * -u)
            out += [(i, p, rank, n, -u, -s) for rank, (s, n) in enumerate(fits[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("scale,slices", [(30, 8192), (3, 16), (1 << 31, 32)])
def test_negatives_equal_plain_search(spark, monkeypatch, scale, slices):
    monkeypatch.setattr(hardneg, "ROWS_A_SLICE", slices)
    monkeypatch.setattr(hardneg, "ANCHORS_A_GROUP", 4)
    monkeypatch.setattr(hardneg, "BLOCK_ROWS", 7)
    rng = random.Random(scale)
    rows = [(i, "hot" if rng.random() < 0.3 else f"l{i % 4}", tuple(rng.randint(-scale, scale) for _ in range(3)), i % 10 == 0)
            for i in range(160)]
    rows += rows[:9] + [(900 + i, "hot", rows[0][2], False) for i in range(30)] + [(950, "lone", (1, 2, 3), True)]
    items = spark.createDataFrame([(*r, 7) for r in rows] + [(None, "l1", (1, 1, 1), True, 0), (3, None, (1, 1, 1), True, 0),
                                                            (4, "l1", None, True, 0)],
                                  "id long, label string, q array<long>, is_anchor boolean, slot int").repartition(3)
    got = sorted(tuple(r) for r in hardneg.hard_negatives(items).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    want = plain_negatives(rows)
    assert got == want and (scale > 3 or len(want) > 100)


def test_negatives_of_odd_vectors(spark):
    rows = [(0, [0.5, 0.25]), (1, [0.5, float("nan")]), (2, [0.5, None]), (3, None), (4, [float("inf"), 1.0]), (5, []), (6, [1.0, -0.001])]
    q = hardneg.quantised(spark.createDataFrame(rows, "id long, embedding array<float>"))
    assert {r["id"]: r["q"] for r in q.collect()} == {0: [128, 64], 5: [], 6: [256, -1]}
    items = q.withColumn("label", q["id"] % 2).withColumn("is_anchor", q["id"] >= 0)
    assert [(r["anchor_id"], r["positive_id"]) for r in hardneg.hard_negatives(items).collect()] == []
    assert hardneg.hard_negatives(items.limit(0)).collect() == []


def test_huge_scores_stop_at_64_bits():
    import numpy as np
    big = np.array([[1 << 62, 1 << 62]])
    assert hardneg._scores(big, big)[0, 0] == (1 << 63) - 1
    assert hardneg._scores(big, -big)[0, 0] == -(1 << 63) + 1


# Byte-level BPE -------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library_and_comes_back(spark, docs, library):
    got = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    want = [(r["doc_id"], library.encode_ordinary(r["text"] or ""), (r["text"] or "").encode()) for r in docs.collect()]
    assert sorted(((r["doc_id"], r["ids"], bytes(r["decoded"])) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r["n_tokens"] == len(r["ids"]) for r in got)


def test_bpe_of_whole_table(spark, library):
    from conftest import SF_CHECK
    text = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("doc_id", "text").collect()}
    got = Q.QUERIES["op13_byte_bpe"](spark, SF_CHECK).collect()
    assert len(got) == len(text)
    for r in got:
        ids = library.encode_ordinary(text[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(text[r["doc_id"]]))


def test_bpe_of_nothing(spark, empty):
    none = bpe.encode(empty, RANKS, public_tokenizers.PATTERN)
    assert none.collect() == bpe.decode(none, RANKS).collect() == []


def test_bpe_of_odd_texts(monkeypatch, library):
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 50)
    monkeypatch.setattr(bpe, "LONG_TEXT", 3000)
    monkeypatch.setattr(bpe, "CHUNK", 17)
    with open(RANKS, "rb") as f:
        encoder = bpe.Encoder(bpe.Vocabulary(f.read(), public_tokenizers.PATTERN))
    rng = random.Random(4)
    texts = ["", None, "<|endoftext|>", "a" * 200_000, "ab" * 100_000 + " x", "\x1c\x85  　", "'s'S don't'll "]
    texts += ["".join(rng.choice("abcet hio\n1é中😀") for _ in range(rng.randint(0, 6000))) for _ in range(60)]
    for lo in range(0, len(texts), 9):
        part = texts[lo:lo + 9]
        ids, offsets = encoder.encode(part)
        assert [ids[a:b].tolist() for a, b in itertools.pairwise(offsets)] == [library.encode_ordinary(t or "") for t in part]


def test_bpe_words_are_replayed_together(monkeypatch, library):
    # One pair after the other, in Python, cost most of the CPU seconds; only words beyond SHORT may need it.
    with open(RANKS, "rb") as f:
        lines = f.read()
    assert bpe.vocabulary(lines, public_tokenizers.PATTERN) is bpe.vocabulary(lines, public_tokenizers.PATTERN)
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("aeinorst hé中") for _ in range(rng.randint(1, 40))).encode() for _ in range(2000)})
    own = [library.encode_single_token(w) if w in library._mergeable_ranks else library._core_bpe.encode_single_piece(w) for w in words]
    own = [x if isinstance(x, list) else [x] for x in own]
    for short, windows in ((96, 8), (96, 1), (20, 3), (0, 8)):
        monkeypatch.setattr(bpe, "SHORT", short)
        monkeypatch.setattr(bpe, "WINDOWS", windows)
        vocab = bpe.Vocabulary(lines, public_tokenizers.PATTERN)
        if short > max(map(len, words)):
            monkeypatch.setattr(vocab, "pair_rank", None)
        ids, offsets = bpe.replay(words, vocab)
        assert [ids[a:b].tolist() for a, b in itertools.pairwise(offsets)] == own


def test_lower_rank_that_a_merge_brings_up_goes_first():
    # ab is c's elder: merging (b, c) makes (a, bc) = abc, which has a lower rank than the merge itself.
    ranks = {bytes([i]): i for i in range(256)} | {b"abc": 300, b"bc": 310, b"dabc": 320}
    lines = b"\n".join(base64.b64encode(t) + b" " + str(i).encode() for t, i in ranks.items())
    vocab = bpe.Vocabulary(lines, r"\S+")
    words = [b"abcabc", b"dabcbc", b"bcbcabcd", b"xbcab"]
    own = tiktoken.Encoding("t", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    ids, offsets = bpe.replay(words, vocab)
    assert [ids[a:b].tolist() for a, b in itertools.pairwise(offsets)] == [own.encode_ordinary(w.decode()) for w in words]


def test_lower_rank_goes_first_in_long_words_too(monkeypatch):
    monkeypatch.setattr(bpe, "SHORT", 0)
    test_lower_rank_that_a_merge_brings_up_goes_first()
