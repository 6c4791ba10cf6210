import datetime as dt
import math
import random

from pyspark.sql import functions as F

from flockwatch.operators import activity, outliers


def _shared(spark, rows):
    return spark.createDataFrame(rows, "trade_date date, fund string, side string, share double")


def test_rolling_stats_golden(spark):
    d = dt.date
    df = _shared(spark, [(d(2020, 1, 1), "f", "S", 0.1), (d(2020, 1, 2), "f", "S", 0.2),
                         (d(2020, 4, 1), "f", "S", 0.4), (d(2020, 1, 1), "g", "S", 0.5)])
    got = {(r.fund, r.trade_date): (r.mean, r.std_dev) for r in outliers.rolling_stats(df).collect()}
    exp = {("f", d(2020, 1, 1)): (0.1, 0.0), ("f", d(2020, 1, 2)): (0.15, 0.070711),
           ("f", d(2020, 4, 1)): (0.3, 0.141421), ("g", d(2020, 1, 1)): (0.5, 0.0)}
    for k, (m, s) in exp.items():
        assert abs(got[k][0] - m) < 1e-9 and abs(got[k][1] - s) < 1e-6


def test_window_vs_brute_force(spark):
    rng = random.Random(7)
    rows = []
    base = dt.date(2020, 1, 1)
    for f in ["a", "b", "c"]:
        for day in sorted(rng.sample(range(400), 60)):
            rows.append((base + dt.timedelta(days=day), f, "S", rng.random()))
    got = {(r.fund, r.trade_date): (r.mean, r.std_dev)
           for r in outliers.rolling_stats(_shared(spark, rows)).collect()}
    for (d0, f, _, _) in rows:
        vals = [s for (d1, f1, _, s) in rows if f1 == f and 0 <= (d0 - d1).days <= 90]
        m = sum(vals) / len(vals)
        sd = math.sqrt(sum((v - m) ** 2 for v in vals) / (len(vals) - 1)) if len(vals) > 1 else 0.0
        assert abs(got[(f, d0)][0] - m) < 1e-12 and abs(got[(f, d0)][1] - sd) < 1e-12


def _trades(spark, rows):
    return spark.createDataFrame(rows, "trade_date date, fund string, side string, acct_key string")


def test_daily_total_counts_accounts_per_fund(spark):
    d = dt.date(2020, 1, 1)
    t = _trades(spark, [(d, "f1", "S", "a"), (d, "f2", "S", "a"), (d, "f2", "S", "b"), (d, "f1", "R", "a")])
    tot = {(r.side): r.total for r in activity.daily_totals(activity.daily_activity(t)).collect()}
    assert tot == {"S": 3.0, "R": 1.0}


def test_z_bound_and_flag(spark):
    # With n active days in the frame the largest z is (n-1)/sqrt(n): 5 days
    # cannot reach 2, 6 can.  Each key gets its own side so totals stay apart.
    base = dt.date(2020, 1, 1)
    rows = []
    for k, side, days in [("five", "S", 5), ("six", "R", 6)]:
        for i in range(days):
            day = base + dt.timedelta(days=i)
            rows.append((day, k, side, f"{k}-x"))
            rows.append((day, "other", side, f"{k}-o"))
            if i == days - 1:
                rows += [(day, k, side, f"{k}-{j}") for j in range(20)]
    flagged = {r.fund for r in outliers.outlier_groups(_trades(spark, rows)).collect()}
    assert flagged == {"six"}


def test_period_alignment_pushes_filter(spark, tmp_path):
    d = dt.date
    t = _trades(spark, [(d(2012, 12, 31), "f", "S", "a"), (d(2013, 1, 1), "f", "S", "a"),
                        (d(2016, 2, 1), "f", "S", "a")])
    t.write.parquet(str(tmp_path / "t"))
    src = spark.read.parquet(str(tmp_path / "t"))
    got = outliers.scored_groups(src, *outliers.REFERENCE_PERIOD)
    assert [r.trade_date for r in got.collect()] == [d(2013, 1, 1)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "trade_date" in plan


def test_flagship_plan_shape(spark):
    from flockwatch.plans import registry
    df = registry.q_outlier_groups(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "Window" in plan
    assert df.count() == 8


def test_rolling_statistics_share_one_window_and_sort(spark):
    shared = spark.createDataFrame([("2020-01-01", "f", "S", 0.1)], "d string, fund string, side string, share double")
    shared = shared.selectExpr("cast(d as date) trade_date", "fund", "side", "share")
    plan = outliers.rolling_stats(shared)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") + plan.count("Window(") == 1 and plan.count("Sort [") == 1, plan


def _trades(spark, rows):
    return spark.createDataFrame(rows, "trade_date date, fund string, side string, acct_key string")


def test_detail_from_stored_trades_reads_flagged_periods_only(spark, tmp_path):
    days = [dt.date(2020, m, d) for m in range(1, 7) for d in (3, 17)]
    rows = [(day, fund, "S", f"a{i}") for k, day in enumerate(days) for fund in "fg" for i in range(2 + 9 * (k == 7 and fund == "f"))]
    trades = _trades(spark, rows)
    outliers.store_trades(trades, str(tmp_path / "t"), "month")
    outliers.scored_groups(trades).write.parquet(str(tmp_path / "z"))
    scored = spark.read.parquet(str(tmp_path / "z"))
    got = outliers.stored_outlier_trades(spark, str(tmp_path / "t"), scored, "month")
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString()
    want = outliers.outlier_trades(trades)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect())) and want.count() == 11


def test_sketches_merge_within_their_error(spark):
    day = F.expr("date_add(date'2021-01-01', cast(id % 30 as int))")
    trades = spark.range(60_000).select(day.alias("trade_date"), F.lit("f").alias("fund"), F.lit("S").alias("side"),
                                        (F.col("id") % 20_000).cast("string").alias("acct_key"))
    sketches = activity.activity_sketches(trades)
    assert sketches.count() == 30
    for start, end in ((None, None), ("2021-01-05", "2021-01-12")):
        exact = activity.align_to_period(trades, start, end).select("acct_key").distinct().count()
        got = activity.accounts_in_period(sketches, start, end).collect()
        assert len(got) == 1 and abs(got[0]["n_accts"] - exact) <= 3 * 1.04 / 64 * exact
    assert activity.accounts_in_period(sketches, "2030-01-01").collect() == []


def test_few_flagged_groups_are_broadcast_to_the_trades(spark):
    base = dt.date(2020, 1, 1)
    rows = [(base + dt.timedelta(days=d), f, "S", f"{f}{a}", 1.0) for d in range(20) for f in "ab"
            for a in range(9 if (d, f) == (19, "a") else 2)]
    trades = spark.createDataFrame(rows, "trade_date date, fund string, side string, acct_key string, usd double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = outliers.outlier_trades(trades.unionAll(trades))
        got = {(r.trade_date, r.fund, r.acct_key) for r in df.collect()}
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {(base + dt.timedelta(days=19), "a", f"a{a}") for a in range(9)} and df.count() == 9
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_segment_trades_join_customers_before_line_items(spark, tmp_path):
    from flockwatch.sources import adapters
    day = dt.datetime(2020, 1, 2)
    tables = {"lineitem": ([(1, 5, 6, 1, 2.0, "A", "F", day), (2, 5, 6, 1, 3.0, "N", "F", day), (2, 5, 6, 2, 4.0, "R", "F", day)],
                           "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, "
                           "l_returnflag string, l_linestatus string, l_shipdate timestamp"),
              "orders": ([(1, 7, "P"), (2, 8, "Q"), (2, None, "Q")], "o_orderkey long, o_custkey long, o_orderpriority string"),
              "customer": ([(7, 3, "SEG"), (8, 4, "SEG"), (8, 5, "SEG")], "c_custkey long, c_nationkey int, c_mktsegment string")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    df = adapters.trades_by_segment(spark, str(tmp_path))
    got = sorted((r.side, r.acct_key, r.usd_gross_amt) for r in df.collect())
    assert got == [("A", "3", 2.0), ("R", "4", 4.0), ("R", "5", 4.0)]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    top = [x for x in plan.splitlines() if "Join Inner" in x][0]
    assert "l_orderkey" in top
