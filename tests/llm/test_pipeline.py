"""The pipeline's stages, each held against what it may keep of its own input."""

import os
import random

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_documents import brute_components, documents, prose

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    seen, bench = {}, [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        rows = out.collect()
        before = {r["doc_id"]: r for r in docs.collect()}
        assert {r["doc_id"] for r in rows} <= set(before)
        if name != "mixing":
            assert out.columns == docs.columns and all(r == before[r["doc_id"]] for r in rows)
        seen[name] = (before, {r["doc_id"] for r in rows})
        docs = out
    before, after = seen["language_id"]
    assert len(after) >= 0.97 * len(before)
    before, after = seen["quality_rules"]
    bad = {r["doc_id"] for r in labels.filter("quality = 0").collect()} & set(before)
    assert not bad & after
    before, after = seen["near_duplicates"]
    groups = brute_components([(i, r["text"]) for i, r in before.items()], 5, 80, 100)
    assert after == {c for _, _, c in groups}
    before, after = seen["decontamination"]
    flat = {i: " ".join(r["text"].split()) for i, r in before.items()}
    leaks = {i for i, t in flat.items() if any(" ".join(b.split()) in t for b in bench)}
    assert after == set(before) - leaks


def test_run_is_its_stages(spark, tmp_path):
    r = random.Random(8)
    rows = [(i, prose(r, 70), r.choice(["en", "fr"]), r.choice(["a", "b"])) for i in range(30)]
    rows += [(100, rows[0][1], "en", "a"), (101, "short", "en", "a"), (102, None, None, None)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, rows[5][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {x["doc_id"]: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert not {100, 101, 102, 5} & set(got) and len(got) > 10
    assert all(0 < x["taken"] <= 2 * x["size"] for x in got.values())
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert {x["doc_id"]: x for x in docs.collect()} == got


def test_run_leaves_only_what_its_result_reads(spark, tmp_path):
    top = f"{spark.conf.get('spark.checkpoint.dir')}/sievewell/{spark.sparkContext.applicationId}"
    before = set(os.listdir(top)) if os.path.isdir(top) else set()
    assert corpus_pipeline.run(spark, SF).count() > 0
    left = {n.rsplit("-", 1)[0] for n in set(os.listdir(top)) - before}
    assert left <= {"pipeline-decontamination", "mix-sizes", "mix-placed"}


def test_stages_on_nothing(spark, tmp_path):
    none = documents(spark, []).withColumn("extra", F.lit(1))
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
