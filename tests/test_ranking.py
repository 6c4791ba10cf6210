import random

from flockwatch.operators.ranking import global_positions, group_positions


def test_global_positions_total_order(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 50), f"k{i:04d}") for i in range(2000)]
    df = spark.createDataFrame(rows, "a int, b string")
    got = {(r.a, r.b): r.pos for r in global_positions(df, ["a", "b"], "pos", partitions=7).collect()}
    exp = {k: i for i, k in enumerate(sorted(rows))}
    assert got == exp


def test_group_positions_with_a_hot_group(spark):
    # One group holds most rows; it spans several range partitions.
    rows = [("hot", i) for i in range(3000)] + [(f"g{j}", i) for j in range(20) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, v int")
    got = group_positions(df, ["g"], ["v"], "pos", partitions=6).collect()
    assert all(r.pos == r.v for r in got)
    assert len(got) == len(rows)
