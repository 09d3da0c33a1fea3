"""The q-gram index of lexicons against plain containment."""

import random

import pytest
from pyspark.sql import functions as F

from sievewell.operators import lexicon


def made(n_tokens, n_texts, seed):
    r = random.Random(seed)
    letters = "abcdefgh日é😀 "
    word = lambda a, b: "".join(r.choices(letters, k=r.randint(a, b)))
    tokens = [(r.randint(0, 40), "", 1, 0.5, word(1, 3) if r.random() < 0.001 else word(4, 12)) for _ in range(n_tokens)]
    tokens = [(p, f"lex{p}", c, w, t) for p, _, c, w, t in tokens]
    texts = [(i, word(0, 200)) for i in range(n_texts)]
    texts = [(i, t + r.choice(tokens)[4] * (i % 3 == 0)) for i, t in texts] + [(n_texts, None), (n_texts + 1, ""), (n_texts + 2, "a"), (n_texts + 3, "abcd" * 50_000)]
    return tokens, texts


SCHEMA = "position int, lexicon_id string, category int, weight double, token string"


@pytest.mark.parametrize("most", [lexicon.MOST_BROADCAST, 0])
def test_index_equals_containment(spark, most):
    tokens, texts = made(50_000, 60, 1)
    table = spark.createDataFrame([*tokens, (1, "lex1", 1, 0.5, ""), (2, "lex2", 1, 0.5, tokens[0][4])], SCHEMA)
    messages = spark.createDataFrame(texts, "msg_id long, norm string").withColumn("gram", F.lit("x"))
    found = lexicon.lexicon_search(messages, table, most_broadcast=most)
    want = {(i, p) for i, t in texts if t for p, _, _, _, token in [*tokens, (2, "", 1, 0.5, tokens[0][4])] if token in t}
    got = found.select("msg_id", "position").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 500
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_small_and_large_lexicons_give_the_same(spark, monkeypatch):
    tokens, texts = made(300, 40, 2)
    lexicons = [lexicon.Lexicon(f"lex{p % 3}", 1, tuple(t for q, *_, t in tokens if q == p)) for p in range(5)]  # ids repeat
    messages = spark.createDataFrame(texts, "msg_id long, norm string")
    rows = lambda: sorted(tuple(r) for r in lexicon.lexicon_join(messages, lexicons).select("msg_id", "lexicon_id", "position").collect())
    large = rows() if sum(len(x.tokens) for x in lexicons) > lexicon.LITERAL_TOKENS else None
    monkeypatch.setattr(lexicon, "LITERAL_TOKENS", 10_000)
    small = rows()
    monkeypatch.setattr(lexicon, "LITERAL_TOKENS", 0)
    assert small == rows() and large in (None, small) and small


def test_no_tokens_and_no_texts(spark):
    messages = spark.createDataFrame([(1, "abc")], "msg_id long, norm string")
    assert lexicon.lexicon_join(messages, []).count() == 0
    assert lexicon.lexicon_search(messages, spark.createDataFrame([], SCHEMA)).count() == 0
    assert lexicon.lexicon_search(messages.limit(0), spark.createDataFrame([(1, "a", 1, 0.5, "abc")], SCHEMA)).count() == 0


def test_texts_stay_in_their_tasks_and_are_not_copied_by_gram(spark):
    """A small index goes to the texts: what leaves a text is one row a lexicon found, and not one a gram."""
    tokens, texts = made(500, 20, 4)
    messages = spark.createDataFrame(texts, "msg_id long, norm string")
    plan = lexicon.lexicon_search(messages, spark.createDataFrame(tokens, SCHEMA))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_join" not in plan and "gram" not in plan and "found" in plan
