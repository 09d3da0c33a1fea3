"""Rank selection against numpy and against Spark's own percentiles."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewell.operators import metrics, ranks

SHARES = (0.0, 0.5, 0.9, 0.95, 0.99, 1.0)


def rows(n, seed, kind):
    r = random.Random(seed)
    make = {
        "even": lambda: r.uniform(-5, 5), "few": lambda: float(r.randint(0, 3)), "far": lambda: r.choice([1e-9, 1.0, 2.0, 3.0, 1e12, -1e300, 1e300]),
        "log": lambda: r.lognormvariate(0, 6), "one": lambda: 7.25,
    }[kind]
    return [(r.choice(["a", "b", None, "hot", "hot", "hot"]), make() if r.random() > 0.05 else None) for _ in range(n)]


@pytest.mark.parametrize(("kind", "bins"), [("even", 1024), ("few", 1024), ("far", 32), ("log", 64), ("one", 4)])
def test_with_and_without_keys(spark, kind, bins):
    given = rows(400, 1, kind)
    df = spark.createDataFrame(given, "k string, x double")
    by = {}
    for k, x in given:
        by.setdefault(k, []).append(x)
        by.setdefault("all", []).append(x)
    for nearest, method in ((False, "linear"), (True, "inverted_cdf")):
        got = {r["k"]: r["p"] for r in ranks.percentiles(df, "x", SHARES, ["k"], nearest, bins).collect()}
        got["all"] = ranks.percentiles(df, "x", SHARES, (), nearest, bins).first()["p"]
        assert set(got) == set(by)
        for k, p in got.items():
            want = np.quantile([x for x in by[k] if x is not None], SHARES, method=method)
            assert p == pytest.approx(want.tolist(), rel=1e-12)


def test_no_rows_nulls_and_many_groups(spark, monkeypatch):
    none = spark.createDataFrame([], "k string, x double")
    assert ranks.percentiles(none, "x", (0.5,)).first()["p"] == [None]
    assert ranks.percentiles(none, "x", (0.5,), ["k"]).count() == 0
    nulls = spark.createDataFrame([("a", None), ("b", 2.0)], "k string, x double")
    assert {r["k"]: r["p"] for r in ranks.percentiles(nulls, "x", (0.5, 1.0), ["k"]).collect()} == {"a": [None, None], "b": [2.0, 2.0]}
    df = spark.createDataFrame(rows(300, 2, "even"), "k string, x double")
    few = {r["k"]: r["p"] for r in ranks.percentiles(df, "x", SHARES, ["k"]).collect()}
    monkeypatch.setattr(ranks, "MOST_GROUPS", 1)
    for k, p in {r["k"]: r["p"] for r in ranks.percentiles(df, "x", SHARES, ["k"]).collect()}.items():
        assert p == pytest.approx(few[k])


def test_latency_equals_percentile(spark):
    df = spark.createDataFrame([(i % 3, float((i * 37) % 101)) for i in range(500)], "g int, latency_ms double")
    got = {r["g"]: r for r in metrics.latency(df, "g").collect()}
    want = df.groupBy("g").agg(F.percentile("latency_ms", F.lit(0.95)).alias("p95"), F.count(F.lit(1)).alias("n")).collect()
    for r in want:
        assert got[r["g"]]["p95"] == pytest.approx(r["p95"]) and got[r["g"]]["n"] == r["n"]


def test_many_equal_values(spark):
    df = spark.range(100_000).select((F.col("id") % 1000).cast("double").alias("latency_ms"))
    assert ranks.percentiles(df, "latency_ms", (0.95,)).first()["p"] == [pytest.approx(np.quantile(np.arange(100_000) % 1000, 0.95))]
