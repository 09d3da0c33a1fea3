"""Streams in several micro-batches against batch results: trailing counts, appeals, and the exactly-once ledger."""

import pytest
from pyspark.sql import functions as F

from sievewell.operators import state
from sievewell.plans import measures, streams
from sievewell.streaming import keyed, ledger
from tests.conftest import SF


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """The events in eight files, in order of time; named so that they are read one after another."""
    folder = str(tmp_path_factory.mktemp("events"))
    rows = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts").collect()
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    size = -(-len(rows) // 8)
    for i in range(8):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(folder)
    return folder, schema


def test_trailing_equals_the_batch_at_each_update_and_state_shrinks(spark, files, tmp_path):
    folder, schema = files
    facts = measures.as_facts(streams.events(spark, folder, schema, 1))
    day = 86400
    progress = keyed.run_available(keyed.trailing(facts, day, "0 seconds"), keyed.numbered_sink(out=(f"{tmp_path}/out", "true")), f"{tmp_path}/state")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.select("batch").distinct().count() >= 8
    want = state.trailing(measures.facts(spark, SF), day).select("event_id", "count")
    assert {r["event_id"]: r["count"] for r in got.collect()} == {r["event_id"]: r["count"] for r in want.collect()}
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    slots = measures.facts(spark, SF).select("group_id", "counter_id", F.floor(F.unix_micros("ts") / -(-day * 10**6 // keyed.SLOTS))).distinct().count()
    assert 0 < held[-1] < slots / 3  # of a month of slots, each with a row for its facts, one for its sum and timers, about two days are left
    assert max(held) < 4 * slots


def test_trailing_with_ties_rows_out_of_order_and_short_windows(spark, tmp_path):
    rows = [(i, i % 2, "c", 1_700_000_000 + t, d) for i, (t, d) in enumerate([(0, 1), (0, 2), (5, 4), (1, 8), (9, 16), (10, 32), (11, 64), (11, -1), (30, 128), (29, 256)])]
    df = spark.createDataFrame(rows, "event_id long, group_id int, counter_id string, t long, delta int").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    for seconds in (1, 10):
        keyed.run_available(keyed.trailing(stream, seconds), keyed.numbered_sink(out=(f"{tmp_path}/out{seconds}", "true")), f"{tmp_path}/state{seconds}")
        got = {r["event_id"]: r["count"] for r in spark.read.parquet(f"{tmp_path}/out{seconds}").collect()}
        assert got == {i: sum(e for _, h, _, u, e in rows if h == g and t - seconds <= u <= t) for i, g, _, t, _ in rows}


def test_appeals_equal_the_batch_also_after_a_restart(spark, files, tmp_path):
    folder, schema = files
    sink = keyed.numbered_sink(accepted=(f"{tmp_path}/accepted", "reason = ''"), rejected=(f"{tmp_path}/rejected", "reason <> ''"))
    seen = []

    def dies(batch, number):
        sink(batch, number)
        seen.append(number)
        if len(seen) == 3:
            raise RuntimeError("killed after its write")

    def judged():
        appeals = measures.as_appeals(streams.events(spark, folder, schema, 1)).withColumn("appeal_id", F.col("appeal_id") % 300)
        return keyed.judged_appeals(*state.split_appeals(appeals))

    with pytest.raises(Exception, match="killed"):
        keyed.run_available(judged(), dies, f"{tmp_path}/state")
    keyed.run_available(judged(), sink, f"{tmp_path}/state")
    batch = measures.appeals(spark, SF).withColumn("appeal_id", F.col("appeal_id") % 300)
    good, malformed = state.split_appeals(batch)
    row = lambda r: (r["appeal_id"], r["rationale_id"], r["at"])
    micros = lambda df: df.withColumn("at", F.unix_micros("ts"))
    accepted = sorted(map(row, spark.read.parquet(f"{tmp_path}/accepted").collect()))
    assert accepted == sorted(map(row, micros(state.first_of_each(good)).collect()))
    rejected = spark.read.parquet(f"{tmp_path}/rejected")
    assert sorted(map(row, rejected.filter("reason = 'malformed'").collect())) == sorted(map(row, micros(malformed).collect()))
    assert rejected.filter("reason = 'duplicate'").count() == good.count() - len(accepted) > 0


@pytest.mark.parametrize("compact_every", [2, 3, 100])
def test_ledger_survives_a_kill_between_write_and_commit(spark, files, tmp_path, monkeypatch, compact_every):
    folder, schema = files
    book = ledger.Ledger(spark, f"{tmp_path}/counts", compact_every=compact_every)
    commit, tried = ledger.Ledger.commit, []

    def dies(self, number, snapshot):
        tried.append(number)
        if len(tried) == 4:
            raise RuntimeError("killed before its commit")
        commit(self, number, snapshot)

    updates = measures.as_updates(streams.events(spark, folder, schema, 1)).withColumn("batch_id", F.col("event_id"))
    monkeypatch.setattr(ledger.Ledger, "commit", dies)
    with pytest.raises(Exception, match="killed"):
        ledger.run_available(updates, ledger.atomic_updates(book), f"{tmp_path}/state")
    half = book.counts()
    assert len(book.commits()) == 3 and half.count() > 0
    ledger.run_available(updates, ledger.atomic_updates(book), f"{tmp_path}/state")
    batch = spark.read.parquet(f"{SF}/events.parquet")
    want = state.valid_updates(measures.as_updates(batch).withColumn("batch_id", F.col("event_id"))).groupBy("group_id", "counter_id").agg(F.sum("delta").alias("count"))
    key = lambda df: sorted(tuple(r) for r in df.select("group_id", "counter_id", "count").collect())
    assert key(book.counts()) == key(want) and len(book.commits()) == 8
    for number in book.commits():  # a repeated batch changes nothing
        book.merge(spark.createDataFrame([(1, 1, "click", 99)], "batch_id long, group_id long, counter_id string, delta long"), number)
    book.vacuum()
    assert key(book.counts()) == key(want)


def test_ledger_without_rows_and_with_a_bad_update(spark, tmp_path):
    book = ledger.Ledger(spark, f"{tmp_path}/counts")
    assert book.counts() is None
    schema = "batch_id long, group_id string, counter_id string, delta long"
    put = ledger.atomic_updates(book)
    put(spark.createDataFrame([], schema), 0)
    assert book.counts().count() == 0
    put(spark.createDataFrame([(1, "g", "a", 2), (1, "g", "", 2), (2, "g", "b", 5), (2, "g", "b", -1)], schema), 1)
    assert [tuple(r) for r in book.counts().collect()] == [("g", "b", 4)]


def test_trailing_holds_one_timer_and_one_value_of_sums_a_key(spark, tmp_path):
    """Facts in many slots of few keys: state is a row for each slot's facts, and for each key its sums and a timer; then all of it goes."""
    rows = [(i, i % 2, "c", 1_700_000_000 + 3600 * (i // 2), i % 5 - 1) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id long, group_id int, counter_id string, t long, delta int").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    far = df.limit(1).withColumn("ts", F.timestamp_seconds(F.lit(1_800_000_000))).withColumn("group_id", F.lit(9))
    for part in (df, far):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        progress = keyed.run_available(keyed.trailing(stream, 7 * 86400), keyed.numbered_sink(out=(f"{tmp_path}/out", "true")), f"{tmp_path}/state")
        held = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
        assert held[0] <= 200 + 2 * 4 + 4 and held[-1] <= (212 if part is df else 8)
    got = {r["event_id"]: r["count"] for r in spark.read.parquet(f"{tmp_path}/out").filter("group_id <> 9").collect()}
    assert got == {i: sum(e for _, h, _, u, e in rows if h == g and t - 7 * 86400 <= u <= t) for i, g, _, t, _ in rows}
