import random

import pytest

from flockwatch.operators.overlap import overlap_above


def _long(spark, sets, key):
    rows = [(k, a) for k, s in sets.items() for a in s]
    return spark.createDataFrame(rows, f"{key} long, acct_key string")


@pytest.mark.parametrize("prefix", [True, None])
@pytest.mark.parametrize("t,strict", [(0.8, True), (0.2, True), (0.5, False)])
def test_prefix_filtered_join_equals_brute_force(spark, t, strict, prefix):
    rng = random.Random(int(t * 10) + strict)
    hot = "H"  # an item present in most sets
    left = {i: {f"a{x}" for x in rng.sample(range(30), rng.randint(1, 9))} | ({hot} if rng.random() < 0.7 else set())
            for i in range(40)}
    right = {j: {f"a{x}" for x in rng.sample(range(30), rng.randint(1, 9))} | ({hot} if rng.random() < 0.7 else set())
             for j in range(35)}
    got = {(r.l, r.r): r.overlap for r in
           overlap_above(_long(spark, left, "l"), _long(spark, right, "r"), ["l"], ["r"], t, strict,
                         prefix_filter=prefix).collect()}
    exp = {}
    for i, a in left.items():
        for j, b in right.items():
            n = len(a & b)
            c = n / min(len(a), len(b))
            if (c > t if strict else c >= t) and n:
                exp[(i, j)] = n
    assert got == exp


def test_shared_key_columns(spark):
    left = spark.createDataFrame([(1, 0, "x"), (1, 0, "y"), (2, 0, "x")], "ms int, l long, acct_key string")
    right = spark.createDataFrame([(1, 5, "x"), (1, 5, "y"), (2, 5, "z")], "ms int, r long, acct_key string")
    got = {(r.ms, r.l, r.r) for r in overlap_above(left, right, ["l"], ["r"], 0.5, shared=["ms"]).collect()}
    assert got == {(1, 0, 5)}


def test_plain_index_size_check(spark):
    from flockwatch.operators.overlap import inverted_index_size
    left = _long(spark, {0: {"H", "a"}, 1: {"H"}, 2: {"b"}}, "l")
    right = _long(spark, {0: {"H"}, 1: {"H", "b"}}, "r")
    pairs, rows = inverted_index_size(left, right, ["acct_key"])
    assert (pairs, rows) == (2 * 2 + 1 * 1, 4 + 3)
