"""Copied runs of words and tokens like keys against loops; scorers whose failures stay with their rows."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from sievewell.functions import boundary
from sievewell.operators import scoring
from sievewell.plans import outputs, screen
from sievewell.sources.tables import messages
from tests.conftest import SF


def runs(text, n):
    w = (text or "").split()
    return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]


def test_echoes_are_those_of_a_loop(spark):
    r = random.Random(3)
    say = lambda: None if r.random() < 0.1 else " ".join(r.choice("abc") for _ in range(r.randint(0, 12)))
    rows = [(r.choice([1, 2, None]), r.choice([0, 1, 2, 3, None]), say()) for _ in range(80)] + [(1, 2, "a b c a b c")] * 2
    df = spark.createDataFrame(rows, "k int, t int, text string")
    got = {(x["k"], x["t"]): (x["copied"], x["first"]) for x in boundary.echoes(df, df, ["k"], "t", most=3).collect()}
    want = {}
    for k, t, text in rows:
        if k is not None and t is not None:
            heard = {x for k2, t2, text2 in rows if k2 == k and t2 is not None and t2 < t for x in runs(text2, 4)}
            want.setdefault((k, t), set()).update(i + 1 for i, x in enumerate(runs(text, 4)) if x in heard)
    assert got == {k: (len(v), min(v)) for k, v in want.items() if v}
    assert boundary.echoes(df.limit(0), df, ["k"], "t").count() == 0


def test_nine_words_are_a_copy_and_eight_are_not(spark):
    source = " ".join(f"w{i}" for i in range(30))
    said = lambda n: "so " + "\t".join(f"w{i}" for i in range(4, 4 + n))
    df = spark.createDataFrame([(said(8), source), (said(9), source), (None, source), (source, None), ("", "")], "o string, s string")
    assert [x[0] for x in df.select(boundary.copies(F.col("o"), F.col("s"))).collect()] == [False, True, False, False, False]


def test_blobs_are_tokens_of_many_bits(spark):
    hexes, key, dull, word = "11acdfb36bb72224148e6160f674b4be45601bff", "AKx9/Qw7+Zt3Lm5Pp0Rs2Vv", "0" * 40, "erberbeeinheitkeiterlich"
    df = spark.createDataFrame([(f"a {hexes}, {dull} {word} {key}.",), (None,), ("",)], "t string")
    first, none, empty = [x[0] for x in df.select(boundary.blobs(F.col("t"))).collect()]
    bits = lambda t: -sum(n / len(t) * math.log2(n / len(t)) for n in Counter(t).values())
    assert [(b["place"], b["kind"], b["length"], b["bits"]) for b in first] == [(1, "hex", 40, round(bits(hexes), 6)), (4, "key", len(key), round(bits(key), 6))]
    assert none == [] and empty == []


def signals(spark, n=40):
    return screen.signals(messages(spark, SF).filter(f"msg_id < {n}"))


def test_a_scorer_that_raises_on_some_rows_loses_none(spark):
    def odd(rows):
        if any(r["msg_id"] % 5 == 0 for r in rows):
            raise RuntimeError("no")
        return [{"category": 7, "severity": 3, "confidence": 0.7, "rationale_id": "x_v1"} for _ in rows]

    got = {r["msg_id"]: r for r in scoring.classified(signals(spark), scoring.of_function(odd, ["msg_id"])).collect()}
    assert len(got) == 40
    for k, r in got.items():
        assert (r["model_health"], r["verdict"]["category"], r["verdict"]["actions"]["warn"]) == (("inference_error", 0, False) if k % 5 == 0 else ("healthy", 7, True))


def test_answers_of_any_form_become_verdicts(spark):
    text = messages(spark, SF).filter("msg_id = 4").first()["text"]
    answers = {
        0: {}, 1: {"category": "x", "severity": 1, "confidence": 0.5}, 2: {"category": 16, "severity": 1, "confidence": 0.5}, 3: {"category": 0, "severity": 0, "confidence": 0.1, "reason_codes": 7},
        4: {"category": 7, "severity": 3, "confidence": 0.9, "rationale_id": " ".join(text.split()[:9])}, 5: {"category": 7, "severity": 3, "confidence": 0.2, "counter_updates": [{"counter_id": "c", "delta": 1}]},
        6: {"category": 7, "severity": 3, "confidence": 0.9, "counter_updates": [{"counter_id": "c", "delta": 2}], "model_health": "dependency_missing"}, 7: None, 8: {"category": 0, "severity": 0, "confidence": 0.1, "rationale_id": ""},
    }
    fn = scoring.of_function(lambda rows: [answers[r["msg_id"]] for r in rows], ["msg_id"])
    got = {r["msg_id"]: r for r in scoring.classified(signals(spark, 9), fn).collect()}
    bad = "inference_error"
    assert [got[k]["model_health"] for k in range(9)] == [bad, bad, bad, bad, bad, "healthy", "model_unavailable", bad, "healthy"]
    assert got[4]["verdict"]["rationale_id"] == "model_unavailable_rule_only_v1" and got[4]["verdict"]["category"] == 0
    assert got[5]["counter_updates"] == [] and got[5]["verdict"]["category"] == 0  # too unsure, another verdict in its place
    assert got[6]["verdict"]["category"] == 7 and got[6]["counter_updates"][0]["delta"] == 2 and got[8]["verdict"]["rationale_id"] == "safe_benign_v1"
    assert "text" not in scoring.classified(signals(spark, 9), fn).columns


def test_a_vector_goes_to_python_once(spark):
    plan = outputs.scored(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [score(") <= 1 and "CartesianProduct" not in plan


def test_echoes_leave_tasks_in_buckets_and_not_run_by_run(spark, monkeypatch):
    """Many buckets, several tasks and texts over many slices give what a loop gives; a row for each run would be 4,000 or more."""
    r = random.Random(5)
    told = [" ".join(r.choice("abcdefgh") for _ in range(60)) for _ in range(30)]
    rows = [(i % 3, i, f"{' '.join(r.sample(told, 1))} w{i} {r.choice(told)[:30]}") for i in range(80)] + [(0, 90, None), (None, 91, told[0]), (1, None, told[0])]
    df = spark.createDataFrame(rows, "k int, t int, text string").repartition(5)
    monkeypatch.setattr(boundary, "_SHARE", 50)
    got = {(x["k"], x["t"]): (x["copied"], x["first"]) for x in boundary.echoes(df, df, ["k"], "t").collect()}
    want = {}
    for k, t, text in rows:
        if k is not None and t is not None:
            heard = {x for k2, t2, text2 in rows if k2 == k and t2 is not None and t2 < t for x in runs(text2, 9)}
            found = {i + 1 for i, x in enumerate(runs(text, 9)) if x in heard}
            want |= {(k, t): (len(found), min(found))} if found else {}
    assert got == want and len(want) > 30
    packed = df.filter("k IS NOT NULL AND t IS NOT NULL").selectExpr("xxhash64(k) AS k", "cast(t AS long) AS at", "3 AS role", "text").mapInArrow(boundary._packer(9, 3), boundary._PACKED)
    assert 0 < packed.count() <= 5 * 9


def test_short_outputs_do_not_take_their_source_apart(spark):
    """A run is looked for in the closed-up source; only the output is cut into runs."""
    df = spark.createDataFrame([("a b c", " x\ta  b c\n"), ("a b c", "xa b c"), ("a b c", "a b cx"), ("a b", "a b"), ("q a b c", "a b c"), ("b c d e", "a b c d e f")], "o string, s string")
    assert [x[0] for x in df.select(boundary.copies(F.col("o"), F.col("s"), most=2)).collect()] == [True, False, False, False, True, True]
    assert "arrays_overlap" not in df.select(boundary.copies(F.col("o"), F.col("s")))._jdf.queryExecution().analyzed().toString()


def test_python_gets_small_batches_of_texts(spark):
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    for k in keys:
        spark.conf.unset(k)
    signals(spark)
    assert 0 < int(spark.conf.get(keys[0])) <= 1000 and 0 < int(spark.conf.get(keys[1])) <= 4 << 20
