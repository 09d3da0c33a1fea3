"""Manifests set by hand, and line breaks against a loop."""

import random

from pyspark.sql import functions as F

from sievewell.operators import manifest, packs
from sievewell.sources import openpacks


def broken(items, width, indent):
    lines = []
    for x in items:
        if lines and len(lines[-1] + ", " + x) <= width:
            lines[-1] += ", " + x
        else:
            lines.append(x)
    return (",\n" + " " * indent).join(lines)


def test_lines_break_where_a_loop_breaks_them(spark):
    r = random.Random(1)
    rows = [["X" * r.randint(1, 30) for _ in range(r.randint(0, 9))] for _ in range(60)] + [[], ["Y" * 99, "Z"], ["A" * 29, "B" * 29], ["A" * 29, "B" * 30]]
    df = spark.createDataFrame([(x,) for x in rows], "x array<string>")
    assert [x[0] for x in df.select(manifest.wrapped(F.col("x"))).collect()] == [broken(x, 60, 18) for x in rows]


def compiled(spark, jurisdiction, community, **kw):
    opened = openpacks.opened(spark.createDataFrame([(1, jurisdiction), (2, community)], "i int, text string"), manifest.FIELDS)
    one = lambda i, name: opened.filter(f"i = {i} AND problem IS NULL").select(F.struct(*manifest.FIELDS).alias(name))
    bundles = spark.range(1).select(F.lit("b").alias("bundle")).join(one(1, "jurisdiction"), F.lit(True), "left").join(one(2, "community"), F.lit(True), "left")
    return manifest.compiled(bundles, "Judge.\n\n", ("NEWS_CONTEXT",), **kw)


def test_a_manifest_as_it_should_stand(spark):
    j = '{"skill_id":"j.x","overrides":[{"category":4,"severity_floor":4},{"category":99},{"severity_floor":2}],"allowed_contexts":["NEWS_CONTEXT","EDUCATION_CONTEXT"]}'
    c = '{"rules":[{"category":9,"action":"warn","suggest_redact":true},{"category":15}],"group_risk_counters":[{"counter_id":"c","thresholds":{"label_at":3,"escalate_at":"7"}},{}],"community_profile":{"age_mode":""}}'
    got = compiled(spark, j, c).first()
    want = f"""[INSTRUCTION]
Judge.

[GLOBAL_BASELINE]
{manifest.BASELINE}

[JURISDICTION_OVERLAY]
id: j.x
overrides:
  - category 4 EXTREMISM severity_floor 4
  - category 99 CAT_99 severity_floor 0
allowed_contexts: NEWS_CONTEXT, EDUCATION_CONTEXT

[COMMUNITY_OVERLAY]
id: <unknown>
rules:
  - category 9 PRIVATE_DATA action=warn suggest_redact=true
  - category 15 COMMUNITY_RULE action=warn
counters:
  - c thresholds 3/7/7
  - <counter> thresholds ?/?/?

[INPUT]
{manifest.INPUT}

[OUTPUT]
{manifest.OUTPUT}
"""
    assert got["text"] == want and got["problem"] is None and got["tokens"] == -(-(want.index("\n[INPUT]")) // 4)
    over = compiled(spark, j, c, budget=got["tokens"] - 1).first()
    assert (over["text"], over["problem"], over["tokens"]) == (None, "over_budget", got["tokens"])


def test_a_manifest_without_overlays_reads_back(spark):
    df = compiled(spark, "[]", None)
    got = {r["section"]: r["text"] for r in packs.sections(df.select(F.col("bundle").alias("manifest"), "text")).collect()}
    assert got == {"INSTRUCTION": "Judge.", "GLOBAL_BASELINE": manifest.BASELINE, "JURISDICTION_OVERLAY": "", "COMMUNITY_OVERLAY": "", "INPUT": manifest.INPUT, "OUTPUT": manifest.OUTPUT}


def test_each_pair_of_packs_is_compiled_once_whatever_the_customers(spark, monkeypatch):
    from sievewell.plans import manifests
    from sievewell.sources import openpacks

    made, opened, compile_, open_ = [], [], manifest.compiled, openpacks.opened
    monkeypatch.setattr(manifest, "compiled", lambda b, *a, **k: made.append(b) or compile_(b, *a, **k))
    monkeypatch.setattr(openpacks, "opened", lambda d, *a, **k: opened.append(d) or open_(d, *a, **k))
    sf = "/root/testdata/sf0.01"
    customers, suppliers = (spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("customer", "supplier"))
    assert manifests.QUERIES["manifest_compile"](spark, sf).count() == customers > 1_000
    assert made[0].count() <= 26 * 14 and opened[1].count() == 13 < suppliers
