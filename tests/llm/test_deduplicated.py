"""One row of each group stays, decided by row and not by id."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sievewell.llm import jaccard
from tests.llm.test_documents import brute_components, documents, prose


def changed(text, r, times):
    words = text.split()
    for at in r.sample(range(len(words)), times):
        words[at] = f"new{r.randint(0, 10**6)}"
    return " ".join(words)


def test_unlike_texts_of_one_id_stay(spark):
    r = random.Random(1)
    a, b, c, d = (prose(r, 60) for _ in range(4))
    docs = documents(spark, [(1, a, "en", "s"), (4, a, "en", "s"), (4, b, "en", "s"), (5, c, "en", "s"), (5, d, "en", "s")])
    got = sorted((x["doc_id"], x["text"]) for x in jaccard.deduplicated(docs).collect())
    assert got == sorted([(1, a), (4, b), (5, c), (5, d)])


def test_copies_with_one_id_or_none(spark):
    r = random.Random(2)
    a, b, c = (prose(r, 60) for _ in range(3))
    rows = [(None, a, "en", "s"), (None, a, "en", "s"), (7, b, "en", "s"), (7, b, "fr", "t"), (None, b, "en", "s"), (None, c, "en", "s"), (8, None, None, None), (8, None, None, None), (9, "", "en", "s")]
    got = jaccard.deduplicated(documents(spark, rows)).collect()
    assert sorted((str(x["doc_id"]), x["text"] or "") for x in got) == sorted([("None", a), ("7", b), ("None", c), ("8", ""), ("8", ""), ("9", "")])


@pytest.mark.parametrize("seed", range(2))
def test_brute_force_with_repeated_and_null_ids(spark, seed):
    r = random.Random(seed)
    base = [prose(r, r.choice([3, 12, 70])) for _ in range(12)]
    texts = [*base, *(changed(t, r, 1) for t in base for _ in range(2)), *r.choices(base, k=20), None, "", " "]
    rows = [(r.choice([None, *range(15)]), t, r.choice(["en", "fr"]), r.choice(["a", None])) for t in texts]
    # Extra columns named like inner ones.
    docs = documents(spark, rows).withColumns({c: F.lit(c) for c in ("node", "id", "_id", "_row", "_node", "copies", "stays", "component", "least", "n")})
    got = jaccard.deduplicated(docs.repartition(3))
    assert got.columns == docs.columns
    kept = [tuple(x)[:4] for x in got.collect()]
    groups = defaultdict(list)
    for at, n, component in brute_components(list(enumerate(t for _, t, *_ in rows)), 5, 80, 100):
        groups[component if n else -1 - at].append(rows[at])
    left = list(kept)
    for members in groups.values():
        mine = [x for x in left if x in members]
        least = min(members, key=lambda x: (x[0] is None, x[0] or 0))[0]
        empty = not (members[0][1] or "").strip()
        mine = mine[:1] if empty else mine
        assert len(mine) == 1 and (empty or mine[0][0] == least)
        left.remove(mine[0])
    assert not left
    again = [tuple(x)[:4] for x in jaccard.deduplicated(docs.repartition(5)).collect()]
    assert sorted(map(str, again)) == sorted(map(str, kept))
