import random

import pytest
from pyspark.sql import types as T

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows with copies, near copies, shared passages and lines, nulls, empty and long texts, repeated rows and ids."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    passage = prose(rng, 60)
    line = "One line that many of these documents hold."
    rows = []
    for i, t in enumerate(base):
        rows.append((i, t + ("\n  " + line.upper() + "\t" if i % 3 == 0 else "\n" + line if i % 3 == 1 else "")))
    for i in range(40, 60):
        rows.append((i, prose(rng, 10) + " " + passage + " " + prose(rng, rng.randint(0, 9))))
    words = base[3].split()
    for i in range(60, 75):
        w = list(words)
        w[rng.randrange(len(w))] = "changed" + str(i)
        rows.append((i, " ".join(w)))
    rows += [(i, base[7]) for i in range(75, 85)]
    rows += [(90, None), (91, ""), (92, " \t\n "), (None, base[8]), (None, base[9] + " " + passage), (93, "\n\n"),
             (94, "é" * 700), (95, "aaaa " * 3000), (96, passage + "\n" + passage), (97, "short one"),
             (98, prose(rng, 5000)), (5, base[5]), (5, base[5]), (6, base[30]), (99, "x" * 450 + base[2]),
             (100, "Mail a.b@example.com or 555-123-4567 now\x00 and then"), (101, "Ünï ÇÖDE " * 30)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                           T.StructField("n_chars", T.LongType()), T.StructField("size", T.StringType()),
                           T.StructField("score", T.StringType()), T.StructField("shard", T.StringType()),
                           T.StructField("key", T.StringType()), T.StructField("n", T.StringType())])
    rows = [(i, t, None, None if k % 11 == 0 else f"s{k % 4}", None, "own", "own", "own", "own", "own")
            for k, (i, t) in enumerate(corpus)]
    return spark.createDataFrame(rows, schema).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
