import datetime as dt

import pytest
from pyspark.sql import functions as F

from flockwatch.functions import keys, sets, stats


def test_sentinels_and_cascade(spark):
    df = spark.createDataFrame(
        [("", "-999", "x", "y"), ("-998", None, "", "c"), (None, "", "-999", ""), ("b", "e", "r", "c")],
        "bin_number string, ext_acct_key string, rep_alias_key string, client_acct_key string")
    out = df.select(keys.cascade_key(*keys.CASCADE_SOURCES).alias("k"),
                    keys.labelled_cascade().alias("l")).collect()
    assert [r.k for r in out] == ["x", "c", "INVALID_KEY", "b"]
    assert [r.l.source for r in out] == ["rep_alias_key", "client_acct_key", "ERROR", "bin_number"]
    assert [r.l.acct_key for r in out] == ["x", "c", "INVALID_KEY", "b"]
    s = spark.createDataFrame([("",), ("-998",), ("-999",), ("0",), (None,)], "v string")
    assert [r[0] for r in s.select(keys.sentinel_to_null("v")).collect()] == [None, None, None, "0", None]


def test_composite_keys_and_dates(spark):
    df = spark.createDataFrame([("F1", "S", "20150716")], "f string, s string, d string")
    r = df.select(keys.fund_side_key("f", "s").alias("k"), keys.parse_yyyymmdd("d").alias("d")).first()
    assert r.k == "F1_@_S" and r.d == dt.date(2015, 7, 16)
    f, s = keys.split_fund_side(F.lit("F1_@_S"))
    r2 = spark.range(1).select(f.alias("f"), s.alias("s"),
                               keys.format_yyyymmdd(F.lit(dt.date(2015, 7, 16))).alias("t")).first()
    assert (r2.f, r2.s, r2.t) == ("F1", "S", "20150716")


def test_numbers(spark):
    df = spark.createDataFrame([("1.5",), (None,)], "v string")
    assert [r[0] for r in df.select(keys.strict_double("v")).collect()] == [1.5, None]
    bad = spark.createDataFrame([("1.5x",)], "v string")
    with pytest.raises(Exception, match="not a number"):
        bad.select(keys.strict_double("v")).collect()
    assert bad.select(keys.lenient_double("v")).first()[0] is None
    assert spark.range(1).select(keys.two_decimals(F.lit(2.0 / 3))).first()[0] == "0.67"


def test_share_and_z(spark):
    df = spark.createDataFrame([(3.0, 6.0, 0.4, 0.05), (None, 6.0, 0.1, 0.1), (3.0, None, 0.1, 0.1),
                                (3.0, 6.0, 0.4, 0.0), (3.0, 0.0, 0.4, 0.1)],
                               "n double, t double, m double, sd double")
    out = df.select(stats.share_of_total("n", "t").alias("s"),
                    stats.guarded_z("n", "t", "m", "sd").alias("z")).collect()
    assert [r.s for r in out][:3] == [0.5, 0.0, 0.0]
    assert abs(out[0].z - 2.0) < 1e-12
    assert out[3].z == 0.0 and out[4].z == 0.0


def test_array_sets(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["b", "c", "d", "e"])], "a array<string>, b array<string>")
    r = df.select(sets.overlap_coefficient("a", "b").alias("c"),
                  F.array_sort(sets.set_intersection("a", "b")).alias("i"),
                  F.array_sort(sets.set_difference("b", "a")).alias("d")).first()
    assert abs(r.c - 2 / 3) < 1e-12 and r.i == ["b", "c"] and r.d == ["d", "e"]
