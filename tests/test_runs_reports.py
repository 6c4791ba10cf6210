import datetime as dt
import itertools
import random

from flockwatch.operators import report, runs


def closed_runs(days):
    """Runs of participation that a day without ends: (first, last, length, is that day the last one).

    A run of one day counts only if that day is the last.
    """
    text = "".join("x" if d else "." for d in days)
    out, at = [], 0
    for traded, group in itertools.groupby(text):
        n = len(list(group))
        ends_last = at + n == len(text) - 1
        if traded == "x" and at + n < len(text) and (n > 1 or ends_last):
            out.append((at, at + n - 1, n, int(ends_last)))
        at += n
    return out


def _run(spark, vectors, include_open=False):
    base = dt.date(2020, 1, 1)
    bm, mm, mt = [], [], []
    for mid, vec in enumerate(vectors):
        mm.append((mid, "acct"))
        for i, t in enumerate(vec):
            day = base + dt.timedelta(days=i)
            mt.append((mid, day, f"M{mid}", "S"))
            if t:
                bm.append((day, f"M{mid}", "S", "acct"))
            bm.append((day, f"M{mid}", "S", "other"))
    bm = spark.createDataFrame(bm, "trade_date date, fund string, side string, acct_key string")
    mm = spark.createDataFrame(mm, "model_id long, acct_key string")
    mt = spark.createDataFrame(mt, "model_id long, trade_date date, fund string, side string")
    got = {}
    for r in runs.participation_runs(bm, mm, mt, include_open).collect():
        got.setdefault(r.model_id, []).append(((r.first_date - base).days, (r.last_date - base).days,
                                               r.run_length, r.last_flag))
    return [sorted(got.get(i, [])) for i in range(len(vectors))]


def test_runs_golden_vectors(spark):
    vecs = ["11011", "1010", "0110", "111", "1001"]
    v = [[c == "1" for c in s] for s in vecs]
    assert _run(spark, v) == [[(0, 1, 2, 0)], [(2, 2, 1, 1)], [(1, 2, 2, 1)], [], []]
    assert _run(spark, v, True) == [[(0, 1, 2, 0), (3, 4, 2, 1)], [], [(1, 2, 2, 0)], [(0, 2, 3, 1)], [(3, 3, 1, 1)]]


def test_runs_formula_vs_grouped_runs(spark):
    rng = random.Random(11)
    vecs = [[rng.random() < 0.6 for _ in range(rng.randint(1, 9))] for _ in range(60)]
    got = _run(spark, vecs)
    assert got == [sorted(closed_runs(v)) for v in vecs]


def test_trade_analysis_no_fanout(spark):
    d = dt.date(2020, 1, 1)
    ft = spark.createDataFrame([(d, "F", "S", "a1", "E", "C", "T", 10.0), (d, "F", "S", "a2", "E", "C", "T", 20.0)],
                               "trade_date date, fund string, side string, acct_key string, executing_key string, "
                               "clearing_key string, trading_entity_key string, usd_gross_amt double")
    mt = spark.createDataFrame([(1, 2, d, "F", "S"), (2, 2, d, "F", "S")],
                               "model_id long, min_size long, trade_date date, fund string, side string")
    firm = sorted((r.model_id, r.n_accts, r.sum_usd) for r in report.trade_analysis_firm(ft, mt).collect())
    assert firm == [(1, 2.0, 30.0), (2, 2.0, 30.0)]
    ent = report.trade_analysis_entity(ft, mt)
    assert ent.columns == ["model_id", "min_size", "trade_date", "fund", "side", "trading_entity_key",
                           "n_accts", "sum_usd"]
    line = report.as_text_lines(ent.filter("model_id = 1")).first().value
    assert line == "1,2,2020-01-01,F,S,T,2.0,30.00"
