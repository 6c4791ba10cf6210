import datetime as dt
import itertools
import random
from collections import Counter, defaultdict

import pytest
import seq_mining
from flockwatch.operators import itemsets, mining

DAY1, DAY2, DAY3 = (dt.date(2021, 5, d) for d in (3, 4, 5))


def _named(prefix, *numbers):
    return [f"{prefix}{n}" for n in numbers]


# One fund per rule, minimum size 2; accounts of different funds never meet, so cases are independent.
# fund: baskets in order of size, then {pass count: [(set, baskets that credit it)]} worked out by hand.
CASES = {
    # R1: nothing in common, both are new.
    "new": ([_named("p", 1, 2, 3), _named("q", 1, 2, 3, 4)],
            {1: [("p1 p2 p3", 1), ("q1 q2 q3 q4", 1)], 2: [("p1 p2 p3", 1), ("q1 q2 q3 q4", 1)]}),
    # R1 below the minimum size: nothing.
    "tiny": ([_named("o", 1)], {1: [], 2: []}),
    # R2, 2 of 5: the rest of the second basket is new.
    "part": ([_named("r", 1, 2, 3, 4, 5), _named("r", 1, 2, 6, 7, 8, 9)],
             {1: [("r1 r2 r3 r4 r5", 1), ("r6 r7 r8 r9", 1)]}),
    # R2, 3 of 4, with too little left.
    "stub": ([_named("t", 1, 2, 3, 4), _named("t", 1, 2, 3, 5)], {1: [("t1 t2 t3 t4", 1)], 2: [("t1 t2 t3 t4", 1)]}),
    # R3, little left on both sides: counted.
    "same": ([_named("k", 1, 2, 3), _named("k", 1, 2, 3, 4)], {1: [("k1 k2 k3", 2)], 2: [("k1 k2 k3", 2)]}),
    # R3, the basket has more: counted, and the rest is new; the second pass finds it (R4).
    "more": ([_named("u", 1, 2, 3), _named("u", 1, 2, 3, 4, 5)],
             {1: [("u1 u2 u3", 2), ("u4 u5", 1)], 2: [("u1 u2 u3", 2), ("u4 u5", 1)]}),
    # R4: what is left is known already, so that set is counted.
    "know": ([_named("v", 1, 2, 3), _named("w", 1, 2, 3, 4), _named("v", 1, 2, 3) + _named("w", 1, 2, 3, 4)],
             {1: [("v1 v2 v3", 2), ("w1 w2 w3 w4", 2)], 2: [("v1 v2 v3", 2), ("w1 w2 w3 w4", 2)]}),
    # R3 and R5, 10 of 12 in common, enough left on both sides: the set shrinks, both rests are new;
    # in the second pass both baskets count the common set and one rest each.
    "both": ([_named("m", *range(1, 13)), _named("m", *range(1, 11), 13, 14, 15)],
             {1: [("m1 m10 m2 m3 m4 m5 m6 m7 m8 m9", 1), ("m11 m12", 1), ("m13 m14 m15", 1)],
              2: [("m1 m10 m2 m3 m4 m5 m6 m7 m8 m9", 2), ("m11 m12", 1), ("m13 m14 m15", 1)]}),
}


def _frame(spark, rows):
    return spark.createDataFrame(rows, "trade_date date, fund string, side string, acct_key string")


def _spark_result(res):
    sets = {r.model_id: r for r in res.sets.collect()}
    mem, occ = defaultdict(set), defaultdict(set)
    for r in res.members.collect():
        mem[r.model_id].add(r.acct_key)
    for r in res.trades.collect():
        occ[r.model_id].add((r.trade_date, r.fund, r.side))
    return sets, mem, occ


def _case_rows():
    return [(day, fund, "R", a) for fund, (baskets, _) in CASES.items()
            for day, accounts in zip((DAY1, DAY2, DAY3), baskets, strict=False) for a in accounts]


@pytest.mark.parametrize("fund", sorted(CASES))
def test_decision_table_by_hand(fund):
    """The sequential oracle itself, against the goldens."""
    baskets, golden = CASES[fund]
    for passes, want in golden.items():
        lines = seq_mining.mine(list(enumerate(baskets)), 2, passes)
        assert sorted((" ".join(sorted(x.now)), len(x.seen)) for x in lines) == sorted(want)


@pytest.mark.parametrize("passes", [1, 2])
def test_one_case_per_rule(spark, passes):
    known = {f: g[passes] for f, (_, g) in CASES.items() if passes in g}
    rows = [r for r in _case_rows() if r[1] in known]
    res = mining.recurring_sets(_frame(spark, rows), min_sizes=(2,), iterations=passes)
    sets, mem, occ = _spark_result(res)
    want = [x for g in known.values() for x in g]
    assert sorted((r.set_size, r.n_baskets) for r in sets.values()) == sorted((len(s.split()), n) for s, n in want)
    assert sorted((" ".join(sorted(a)), len(occ[i])) for i, a in mem.items()) == sorted(x for x in want if x[1] > 1)


def test_set_that_would_shrink_to_the_minimum_stays(spark):
    """R5 is strict: two common accounts are not more than three, so the larger set is counted instead (R4)."""
    rows = ([(DAY1, "F", "R", a) for a in _named("z", 1, 2)]
            + [(DAY2, "F", "R", a) for a in _named("z", 1, 2, 3, 4, 5, 6)])
    res = mining.recurring_sets(_frame(spark, rows), min_sizes=(3,), iterations=2)
    sets, mem, occ = _spark_result(res)
    assert [(r.set_size, r.n_baskets) for r in sets.values()] == [(6, 2)]
    assert [sorted(a) for a in mem.values()] == [_named("z", 1, 2, 3, 4, 5, 6)]


def _random_collections(seed, k):
    rng = random.Random(seed)
    rows, colls = [], {}
    for c in range(k):
        nacc, nb = rng.randint(5, 12), rng.randint(6, 16)
        bl = {}
        for j in range(nb):
            d = dt.date(2020, 1, 1) + dt.timedelta(days=j)
            accts = set(rng.sample([f"c{c}a{i}" for i in range(nacc)], rng.randint(1, min(nacc, 8))))
            bl[(d, f"K{c:03d}", "R")] = accts
            rows += [(d, f"K{c:03d}", "R", a) for a in accts]
        colls[c] = bl
    return rows, colls


@pytest.mark.parametrize("seed,k,prefix,ms_list,iters", [(5, 24, None, (1, 2, 3), 2), (13, 6, True, (2,), 1)])
def test_rounds_equal_sequential_on_random_collections(spark, seed, k, prefix, ms_list, iters):
    # Collections use disjoint accounts, so they never interact and one Spark
    # run checks them all against the sequential simulation.  prefix=True
    # forces the prefix-filtered overlap joins inside the rounds.
    rows, colls = _random_collections(seed, k)
    res = mining.recurring_sets(_frame(spark, rows), min_sizes=ms_list, iterations=iters,
                                prefix_filter=prefix)
    sets, mem, occ = _spark_result(res)
    got = defaultdict(list)
    for mid, accts in mem.items():
        fund = next(iter(occ[mid]))[1]
        got[(fund, sets[mid].min_size)].append((tuple(sorted(accts)), tuple(sorted(occ[mid]))))
    n_sets = defaultdict(int)
    for r in sets.values():
        n_sets[r.min_size] += 1
    exp_sets = defaultdict(int)
    for c, bl in colls.items():
        order = sorted(bl.items(), key=lambda kv: (len(kv[1]), kv[0]))
        for ms in ms_list:
            lin = seq_mining.mine(order, ms, iters)
            exp_sets[ms] += len(lin)
            exp = sorted((tuple(sorted(x.now)), tuple(sorted(x.seen))) for x in lin if len(x.seen) > 1)
            assert sorted(got.get((f"K{c:03d}", ms), [])) == exp, (c, ms)
    assert dict(n_sets) == dict(exp_sets)


def _with_hot_account(share):
    """Sixty baskets of 6 to 12 accounts in thirty pairs that share most of them; ``share`` of the baskets hold one account."""
    rng = random.Random(3)
    baskets = {}
    for i in range(30):
        n = rng.randint(6, 9)
        for j in range(2):
            accounts = set(_named(f"h{i}x", *range(n + 2 * j))) - set(_named(f"h{i}x", *range(j)))
            baskets[(dt.date(2019, 1, 1) + dt.timedelta(days=len(baskets)), "HOT", "R")] = accounts
    for key in rng.sample(sorted(baskets), int(share * len(baskets))):
        baskets[key] = baskets[key] | {"everywhere"}
    return baskets


def test_account_of_most_baskets_adds_no_rounds(spark):
    rounds = {}
    for share in (0, 0.7):
        baskets = _with_hot_account(share)
        res = mining.recurring_sets(_frame(spark, [(*k, a) for k, b in baskets.items() for a in b]), min_sizes=(5,), iterations=1)
        rounds[share] = res.rounds
        order = sorted(baskets.items(), key=lambda kv: (len(kv[1]), kv[0]))
        want = sorted((tuple(sorted(x.now)), tuple(sorted(x.seen))) for x in seq_mining.mine(order, 5, 1) if len(x.seen) > 1)
        _, mem, occ = _spark_result(res)
        assert sorted((tuple(sorted(mem[i])), tuple(sorted(occ[i]))) for i in mem) == want and want
    assert rounds[0.7] == rounds[0]


def test_no_baskets(spark):
    res = mining.recurring_sets(_frame(spark, []), min_sizes=(2, 3), iterations=2)
    assert res.members.collect() == res.trades.collect() == res.sets.collect() == []


def test_input_partitioning_does_not_change_result(spark):
    rows, _ = _random_collections(9, 8)
    a = mining.recurring_sets(_frame(spark, rows), min_sizes=(2,), iterations=2)
    b = mining.recurring_sets(_frame(spark, list(reversed(rows))).repartition(7), min_sizes=(2,), iterations=2)
    sa, ma, _ = _spark_result(a)
    sb, mb, _ = _spark_result(b)
    assert sorted(map(sorted, ma.values())) == sorted(map(sorted, mb.values()))
    assert len(sa) == len(sb)


def test_itemsets_by_counting(spark):
    rng = random.Random(21)
    baskets = [rng.sample(range(20, 29), rng.randint(2, 6)) for _ in range(14)]
    rows = [(dt.date(2022, 1, 1) + dt.timedelta(days=i), "F1", "R", f"acct{n}")
            for i, b in enumerate(baskets) for n in b]
    want = Counter(c for b in baskets for k in range(1, 7) for c in itertools.combinations(sorted(b), k))
    want = {tuple(f"acct{n}" for n in c): f for c, f in want.items() if f >= 0.1 * len(baskets)}
    got = itemsets.frequent_itemsets(_frame(spark, rows), num_partitions=2).collect()
    assert {tuple(sorted(r["items"])): r["freq"] for r in got} == want
    assert {r["itemset_size"] for r in got} >= {1, 2, 3}


def test_accounts_of_all_baskets_are_not_broadcast_to_the_decisions(spark):
    rows = [(DAY1, f"f{b}", "S", f"a{b}-{i}") for b in range(30) for i in range(2 + b % 5)]
    members = spark.createDataFrame(rows, "trade_date date, fund string, side string, acct_key string")
    plans = []

    class FirstRound(mining._Pass):
        def _plan(self, turn, versions):
            plan = super()._plan(turn, versions)
            plans.append(plan._jdf.queryExecution().executedPlan().toString())
            raise InterruptedError      # the plan is all that is wanted

    was, mining._Pass = mining._Pass, FirstRound
    try:
        with pytest.raises(InterruptedError):
            mining.recurring_sets(members, (2,), 1, prefix_filter=False)
    finally:
        mining._Pass = was
    # The side that is held in memory whole is the one with a row per basket.
    assert "BroadcastHashJoin" in plans[0] and "BuildLeft" not in plans[0]
    # Accounts are grouped by basket and account alone.
    assert not any("HashAggregate(keys=" in x and "acct_key" in x and "want_bmm" in x for x in plans[0].splitlines())
