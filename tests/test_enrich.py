import pytest

from flockwatch.operators import enrich


def _tables(spark, extra_fact=()):
    raw = spark.createDataFrame(
        [("20200101", "P1", "1", "s1", "b1", "", "", "", "F1", "e", "c", "t", "10.5"),
         ("20200101", "P1", "2", "s1", "-998", "x1", "", "", "F1", "e", "c", "t", "1"),
         ("20200102", "P2", "1", "s1", "", "", "", "", "F2", "e", "c", "t", "2"),
         ("20200102", "P1", "3", "s1", "b9", "", "", "", "F1", "e", "c", "t", "3")] + list(extra_fact),
        ",".join(f"{c} string" for c in [
            "trade_date_key", "prdct_acct_key", "trade_class_key", "shareclass_cusip_key", "bin_number",
            "ext_acct_key", "rep_alias_key", "client_acct_key", "sdm_feed_key", "exec_reltn_key",
            "clearing_reltn_key", "trading_entity_key", "usd_gross_amt"]))
    side = spark.createDataFrame([("1", "S"), ("2", "R"), ("3", "X")], "trade_class_key string, trade_class_code string")
    acct = spark.createDataFrame([("P1", "T1"), ("P2", "T2")], "acct_key string, trust_key string")
    trust = spark.createDataFrame([("T1", "GOOD"), ("T2", "BAD")], "trust_key string, trust_code string")
    feed = spark.createDataFrame([("F1", "OK", "desc", "L1"), ("F2", "ETF", "desc", "L1")],
                                 "sdm_feed_key string, feed_code string, feed_desc string, feed_location_code string")
    return raw, side, acct, trust, feed


def test_build_trades_filters_and_keys(spark):
    raw, side, acct, trust, feed = _tables(spark)
    out = enrich.build_trades(raw, side, acct, trust, feed, trust_codes=("GOOD",)).collect()
    assert sorted((r.side, r.acct_key, r.usd_gross_amt) for r in out) == [("R", "x1", 1.0), ("S", "b1", 10.5)]


def test_missing_key_fails_even_when_ineligible(spark):
    bad = ("20200102", "P1", "9", "s1", "b9", "", "", "", "F1", "e", "c", "t", "3")
    raw, side, acct, trust, feed = _tables(spark, [bad])
    with pytest.raises(Exception, match="key not found in side dimension"):
        enrich.build_trades(raw, side, acct, trust, feed, trust_codes=("GOOD",)).collect()
    ok = enrich.build_trades(raw, side, acct, trust, feed, on_missing="drop", trust_codes=("GOOD",))
    assert ok.count() == 2


def test_duplicate_dimension_key_is_deterministic(spark):
    dim = spark.createDataFrame([("k", "a"), ("k", "b"), ("j", "c")], "key string, v string")
    got = {r.key: r.v for r in enrich.dedupe_dimension(dim, "key", ["v"]).collect()}
    assert got == {"k": "b", "j": "c"}


def test_account_key_sources(spark):
    raw, *_ = _tables(spark)
    got = sorted(map(tuple, enrich.account_key_sources(raw).collect()))
    assert got == [("INVALID_KEY", "ERROR"), ("b1", "bin_number"), ("b9", "bin_number"), ("x1", "ext_acct_key")]


@pytest.mark.parametrize("side_key,eligible", [("1", True), ("3", False)])
@pytest.mark.parametrize("table", ["side", "account", "trust", "feed"])
def test_any_unknown_key_fails_the_job(spark, table, side_key, eligible):
    row = {"acct": "P1", "side": side_key, "feed": "F1"}
    extra_acct = []
    if table == "side":
        row["side"] = "99"
    elif table == "account":
        row["acct"] = "P9"
    elif table == "feed":
        row["feed"] = "F9"
    else:
        row["acct"], extra_acct = "P3", [("P3", "T9")]
    fact = ("20200102", row["acct"], row["side"], "s1", "b9", "", "", "", row["feed"], "e", "c", "t", "3")
    raw, side, acct, trust, feed = _tables(spark, [fact])
    acct = acct.unionByName(spark.createDataFrame(extra_acct, acct.schema))
    out = enrich.build_trades(raw, side, acct, trust, feed, trust_codes=("GOOD",))
    for action in (lambda: out.collect(), lambda: out.groupBy("fund").count().collect(), lambda: out.count()):
        with pytest.raises(Exception, match=f"key not found in {table} dimension"):
            action()
    assert enrich.build_trades(raw, side, acct, trust, feed, on_missing="drop", trust_codes=("GOOD",)).count() == 2


def test_trust_codes_are_required(spark):
    with pytest.raises(ValueError, match="trust_codes"):
        enrich.build_trades(*_tables(spark), trust_codes=())


def test_ineligible_rows_take_only_their_feed_key_to_the_feed_lookup(spark):
    raw, side, acct, trust, feed = _tables(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = enrich.build_trades(raw, side, acct, trust, feed, trust_codes=("GOOD",))
        assert sorted((r.fund, r.acct_key, r.feed_key) for r in out.collect()) == [("P1", "b1", "F1"), ("P1", "x1", "F1")]
        plan = out._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    below = plan[plan.index("Join LeftOuter"):]
    assert "THEN usd_gross_amt" in below and "THEN shareclass_cusip_key" in below
    # Dimensions are read from written tables, whose size the planner knows.
    assert plan.count("parquet") == 4
