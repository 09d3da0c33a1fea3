"""Classifiers learn the same from repeated rows as from one of each."""

import random

import numpy as np
from pyspark.sql import functions as F

from sievewell.llm import langid, quality
from tests.llm.test_documents import documents, prose


def test_repeated_rows_are_learned_once(spark):
    r = random.Random(5)
    rows = [(i, ("der die das " if i % 2 else "the of and ") * 9 + prose(r, 20), "de" if i % 2 else "en", "s") for i in range(24)]
    once, often = documents(spark, rows), documents(spark, rows + rows[:3] * 40)
    labels = spark.createDataFrame([(i, i % 2) for i in range(24)], "doc_id long, quality int")
    a, b = (quality.fit(d, lab, F.lit(True), per_class=8) for d, lab in ((once, labels), (often, labels.union(labels))))
    scores = [[x["s"] for x in once.orderBy("doc_id").select(quality.score(m, F.col("text")).alias("s")).collect()] for m in (a, b)]
    assert scores[0] == scores[1] and len(set(scores[0])) > 2
    a, b = (langid.fit(d, F.lit(True), per_lang=6, windows=2) for d in (once, often))
    assert a.langs == b.langs == ("de", "en")
    assert all(np.array_equal(a.weights[k], b.weights[k]) for k in a.weights)
