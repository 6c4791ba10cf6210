import datetime as dt
import random

from pyspark.sql import functions as F

from flockwatch.operators import baskets as bk


def _members(spark, sets):
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=i), "F", "S", a) for i, s in enumerate(sets) for a in s]
    return spark.createDataFrame(rows, "trade_date date, fund string, side string, acct_key string")


def test_overlap_pairs_vs_python_sets(spark):
    rng = random.Random(3)
    sets = [set(rng.sample(range(15), rng.randint(1, 8))) for _ in range(25)]
    sets = [{f"a{x}" for x in s} for s in sets]
    m = _members(spark, sets)
    got = {(r.a_trade_date, r.b_trade_date): (r.overlap, r.coef)
           for r in bk.basket_overlap_pairs(m, threshold=0.0, strict=True).collect()}
    base = dt.date(2020, 1, 1)
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), i))
    pos = {i: k for k, i in enumerate(order)}
    exp = {}
    for i in range(len(sets)):
        for j in range(len(sets)):
            if pos[i] < pos[j] and sets[i] & sets[j]:
                n = len(sets[i] & sets[j])
                exp[(base + dt.timedelta(days=i), base + dt.timedelta(days=j))] = (n, n / min(len(sets[i]), len(sets[j])))
    assert got == exp


def test_best_match_ties_to_oldest(spark):
    m = _members(spark, [{"a", "b"}, {"a", "c"}, {"a", "d", "e", "f"}])
    got = {r.trade_date.day: r.match_trade_date.day for r in bk.basket_best_match(m).collect()}
    # basket 3 ties (0.5 against both size-2 baskets); the lower ord (day 1) wins.
    assert got[3] == 1 and got[1] == 2 and got[2] == 1


def test_containment_target_and_coverage(spark):
    sets = [{"a", "b", "c", "d", "e"}, {"a", "b", "c", "d", "e", "f"}, {"a", "b", "c", "d"}, {"x"}]
    m = _members(spark, sets)
    target = bk.target_accounts(m, "2020-01-01", "F", "S")
    hits = {r.trade_date.day for r in bk.containment_search(m, target).collect()}
    assert hits == {1, 2}  # 4/5 = 0.8 is not > 0.8
    assert bk.containment_search(m, target.limit(0)).count() == 0
    models = spark.createDataFrame([(0, 2, "a"), (0, 2, "b"), (0, 2, "z"), (1, 3, "a"), (1, 3, "q")],
                                   "model_id long, min_size long, acct_key string")
    vs = {r.model_id: (r.model_ratio, r.overlap) for r in bk.target_vs_sets(models, target).collect()}
    assert vs == {0: (2 / 3, 2)}
    cov = bk.target_coverage(models, target).first()
    assert (cov.uncovered, cov.target_size, cov.pct_text) == (3, 5, "60.0%")


def test_best_match_cascade_equals_plain(spark, monkeypatch):
    import flockwatch.operators.baskets as bmod
    rng = random.Random(21)
    sets = [{f"a{x}" for x in rng.sample(range(20), rng.randint(1, 12))} | ({"HOT"} if rng.random() < 0.8 else set())
            for _ in range(40)]
    m = _members(spark, sets)
    plain = sorted(map(tuple, bk.basket_best_match(m).collect()))
    monkeypatch.setattr(bmod, "PLAIN_PAIRS_PER_ROW", 0.0)  # force the cascade
    cascade = sorted(map(tuple, bk.basket_best_match(m).collect()))
    assert cascade == plain and len(plain) == 40


def test_best_match_with_falling_bound_finds_faint_partners(spark, monkeypatch):
    """Partners far below the last given threshold, baskets without any, and no plain index on the way."""
    import flockwatch.operators.baskets as bmod
    sets = [{f"own{i}_{x}" for x in range(size)} for i, size in enumerate((60, 60, 45, 30, 7))]
    sets[0] |= {"p", "q", "r"}
    sets[1] |= {"p", "q"}
    sets[2] |= {"r"}
    m = _members(spark, sets)
    plain = sorted(map(tuple, bk.basket_best_match(m).collect()))
    asked, join = [], bmod.overlap_above

    def watched(*args, **kwargs):
        asked.append((args[4], kwargs["prefix_filter"]))
        return join(*args, **kwargs)

    monkeypatch.setattr(bmod, "overlap_above", watched)
    monkeypatch.setattr(bmod, "PLAIN_PAIRS_PER_ROW", 0.0)
    falling = sorted(map(tuple, bk.basket_best_match(m, cascade=(0.5, 0.1)).collect()))
    assert falling == plain and len(plain) == 3
    assert [t for t, _ in asked] == [0.5, 0.1, 0.05, 0.025, 0.0125] and all(p for _, p in asked)
