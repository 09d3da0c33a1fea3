"""Version histories against a loop over registrations, sections of manifests, and degraded verdicts."""

import datetime
import random

from pyspark.sql import functions as F

from sievewell.functions import text, verdict
from sievewell.operators import packs

DAY = datetime.date(2026, 1, 1)


def registered(spark, rows):
    rows = [(i, s, v, DAY + datetime.timedelta(d), DAY + datetime.timedelta(d + 90)) for i, (s, v, d) in enumerate(rows)]
    return spark.createDataFrame(rows, "seq int, skill_id string, version string, signed_on date, expires_on date")


def loop(rows):
    """What is kept, one registration after another."""
    held = {}
    for i, (s, v, d) in enumerate(rows):
        numbers = [int(x) if x.isdigit() else 0 for x in v.split(".")]
        now = sorted([*(h for h in held.get(s, []) if h[3] != v), (d, numbers, i, v)], reverse=True)[:3]
        if any(h[2] == i for h in now):
            held[s] = now
    return {(s, h[3], place + 1) for s, now in held.items() for place, h in enumerate(now)}


def kept(spark, rows):
    got = packs.history(registered(spark, rows)).collect()
    assert all(r["is_active"] == (r["place"] == 1) for r in got)
    return {(r["skill_id"], r["version"], r["place"]) for r in got}


def test_a_stale_registration_changes_nothing(spark):
    rows = [("s", f"1.{i}", i) for i in range(4)]
    assert kept(spark, rows) == {("s", "1.3", 1), ("s", "1.2", 2), ("s", "1.1", 3)}
    again = [*rows, ("s", "1.3", -9)]  # with an old date it is older than the three others
    assert kept(spark, again) == loop(again) == {("s", "1.2", 1), ("s", "1.1", 2), ("s", "1.3", 3)}
    stale = [*rows, ("s", "0.9", -1)]
    assert kept(spark, stale) == loop(stale) == kept(spark, rows)


def test_histories_are_those_of_the_loop(spark):
    r = random.Random(4)
    rows = [(r.choice("abcdefgh"), f"{r.randint(0, 2)}.{r.choice(['0', '1', '10', '2'])}", r.randint(0, 9)) for _ in range(300)]
    assert kept(spark, rows) == loop(rows)


def test_sections_keep_their_body_and_miss_marks_in_order(spark):
    marks = [f"[{m}]" for m in packs.SECTIONS]
    whole = "preface " + "".join(f"{m}\nline  {i}\n[x] item  \n\n" for i, m in enumerate(marks))
    wrong = "".join(reversed(marks))
    df = spark.createDataFrame([(1, whole), (2, wrong), (3, "some text"), (4, None), (5, "".join(marks))], "manifest int, text string")
    got = {(r["manifest"], r["section"], r["text"], r["missing"]) for r in packs.sections(df).collect()}
    assert {g for g in got if g[0] == 1} == {(1, m, f"line  {i}\n[x] item", None) for i, m in enumerate(packs.SECTIONS)}
    assert {g for g in got if g[0] == 5} == {(5, m, "", None) for m in packs.SECTIONS}
    assert {g[3] for g in got if g[0] == 2} == {"GLOBAL_BASELINE"} and {g[3] for g in got if g[0] in (3, 4)} == {"INSTRUCTION"}


def test_a_degraded_scorer_keeps_its_codes_and_rationale(spark):
    df = spark.createDataFrame([("model_unavailable", ["URL_RISK", "", "NEWS_CONTEXT"], "own_v1"), ("inference_error", None, ""), ("healthy", [], "x")], "h string, codes array<string>, why string")
    none = F.array().cast("array<string>")
    v = verdict.degraded_verdict(F.col("h"), F.lit(0.9), F.array(F.lit("EMAIL")), none, F.array(), F.col("codes"), F.col("why"))
    got = [r["v"] for r in df.select(v.alias("v")).collect()]
    assert got[0]["reason_codes"] == ["URL_RISK", "NEWS_CONTEXT", "PRIVATE_DATA_PATTERN"] and got[0]["rationale_id"] == "own_v1"
    assert got[1]["reason_codes"] == ["PRIVATE_DATA_PATTERN", "URL_RISK"] and got[1]["rationale_id"] == verdict.DEGRADED
    assert got[2] is None


def test_only_texts_beyond_ascii_are_folded_apart(spark):
    texts = ["PLAIN text", "ＡＢＣ", "Straße", "", None, "ÀÉ", "\x7f", "K"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(text.normalize_text(F.col("t"), table=("", ""))).collect()]
    assert got == ["plain text", "abc", "strasse", "", None, "àé", "\x7f", "k"]
    assert [r[0] for r in df.select(text.unaccent(F.col("t"))).collect()] == ["PLAIN text", "ABC", "Straße", "", None, "AE", "\x7f", "K"]
