"""The as-of join against a search through all entries."""

import random

import pytest
from pyspark.sql import functions as F

from sievewell.operators.asof import as_of


@pytest.mark.parametrize("seconds", [7, 86400])
def test_ties_gaps_nulls_and_several_keys(spark, seconds):
    r = random.Random(seconds)
    key = lambda: (r.choice(["a", "b", None, "hot", "hot", "hot"]), r.choice([1, 2]))
    rows = [(i, *key(), r.choice([None, *range(0, 60)])) for i in range(300)]
    entries = [(*key(), r.choice([None, 5, 5, 20, 21, 50, r.randint(0, 59)]), i % 7, f"v{i}") for i in range(40)]
    left = spark.createDataFrame(rows, "i int, k string, n int, s long").withColumn("ts", F.timestamp_seconds("s")).withColumn("_t", F.lit(1)).drop("_t")
    right = spark.createDataFrame(entries, "k string, n int, s long, seq int, version string").withColumn("ts", F.timestamp_seconds("s"))
    got = as_of(left, right, ["k", "n"], "ts", ["seq", "version"], seconds)
    assert got.columns == [*left.columns, "seq", "version"]
    have = {x["i"]: (x["seq"], x["version"]) for x in got.collect()}
    for i, k, n, s in rows:
        before = [(t, seq, v) for ek, en, t, seq, v in entries if (ek, en) == (k, n) and t is not None and s is not None and t <= s]
        assert have[i] == (max(before)[1:] if before else (None, None))
    assert len(have) == len(rows)


def test_nothing_on_either_side(spark):
    left = spark.createDataFrame([(1, "a")], "i int, k string").withColumn("ts", F.timestamp_seconds(F.lit(1)))
    right = spark.createDataFrame([], "k string, seq int").withColumn("ts", F.timestamp_seconds(F.lit(1)))
    assert [tuple(x) for x in as_of(left, right, ["k"], "ts", ["seq"]).select("i", "seq").collect()] == [(1, None)]
    assert as_of(left.limit(0), right, ["k"], "ts", ["seq"]).count() == 0
