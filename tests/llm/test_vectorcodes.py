"""Vector codes against a search through all entries in plain Python."""

import random

import numpy as np
import pytest

from sievewell.llm import vectorcodes as vc

INF, NAN = float("inf"), float("nan")


def brute(rows, parts=4, entries=256, rounds=4):
    """{row number: (code, error)} and the codebooks."""
    kept = [(i, v, [int(np.floor(1024 * float(x))) for x in v]) for i, v, _ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda k: (k[0] is None, k[0] or 0, k[2]))
    width = len(kept[0][2]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, _, v in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def best(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for c in cut:
                members.setdefault(best(p, c[p])[1], []).append(c[p])
            for i, own in members.items():
                books[p][i] = [sum(x) // len(own) for x in zip(*own)]
    found = [[best(p, c[p]) for p in range(parts)] for c in cut]
    return sorted((k[0] is None, k[0] or 0, "".join(f"{i:02x}" for _, i in f), sum(d for d, _ in f)) for k, f in zip(kept, found)), books


def run(spark, rows, **options):
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("v", vc.F.lit(0)).withColumn("error", vc.F.lit("x"))
    coded, books = vc.compress(vectors, **options)
    return sorted((r["vec_id"] is None, r["vec_id"] or 0, "".join(f"{i:02x}" for i in r["codes"]), r["error"]) for r in coded.collect()), books


def made(n, size, seed, spread=1.0):
    r = random.Random(seed)
    return [(i, [float(np.float32(r.gauss(0, spread))) for _ in range(size)], r.choice([1, 2, None])) for i in range(n)]


def test_equals_a_search_through_all_entries(spark):
    rows = made(300, 12, 1)
    rows += [(i % 40, v, 3) for i, v, _ in rows[:90]] + [(None, rows[0][1], None), (5, rows[5][1], 1)]  # repeated and null ids, ties
    bad = [(900, None, 1), (901, [NAN] * 12, 1), (902, [0.0] * 11 + [INF], 1), (903, [None] + [0.0] * 11, 1), (904, [-INF] + [0.0] * 11, 1)]
    got, books = run(spark, rows + bad, entries=32)
    want, want_books = brute(rows, entries=32)
    assert got == want and [b.tolist() for b in books] == want_books


def test_many_equal_distances(spark):
    r = random.Random(2)
    rows = [(i, [r.choice([0, 1, -1]) / 1024 for _ in range(8)], 0) for i in range(200)]
    assert run(spark, rows, entries=64)[0] == brute(rows, entries=64)[0]


def test_large_components_stay_exact(spark):
    rows = made(40, 8, 3, 3e12)
    ends, _ = run(spark, [(i, [x] * 4, 0) for i, x in enumerate((-3e38, 3e38, 0.0))], entries=2)
    assert [e[2:] for e in ends] == [("00000000", 0), ("01010101", 2**63 - 1), ("01010101", 2**63 - 1)]
    got, books = run(spark, rows, entries=8)
    want, want_books = brute(rows, entries=8)
    assert [b.tolist() for b in books] == want_books
    assert got == [(*w[:3], min(w[3], 2**63 - 1)) for w in want]


def test_few_rows_other_lengths_and_none(spark):
    assert run(spark, [])[0] == []
    assert run(spark, made(3, 4, 4))[0] == brute(made(3, 4, 4))[0]
    vectors = spark.createDataFrame([(1, [1.0] * 3, 1), (2, [1.0] * 4, 1), (3, [2.0] * 8, None), (4, [], None)], "vec_id long, embedding array<float>, label int")
    coded, books = vc.compress(vectors)
    assert {r["vec_id"]: r["error"] for r in coded.collect()} == {1: None, 2: 0, 3: None, 4: None} and len(books[0]) == 1
    assert [r["error"] for r in vc.compress(vectors.filter("vec_id = 1"))[0].collect()] == [None]


@pytest.mark.parametrize("levels", [2, 5, 1000])
def test_tree_finds_the_lowest_index(levels):
    r = np.random.default_rng(levels)
    book, points = r.integers(0, levels, (256, 6)), r.integers(0, levels, (500, 6))
    far = ((points[:, None] - book) ** 2).sum(2)
    at, best = vc.nearest(vc.kd_tree(book, leaf=4), book, points)
    assert (at == far.argmin(1)).all() and (best == far.min(1)).all()


def test_query_over_the_smallest_tables(spark, same):
    from tests.conftest import SF

    same(vc.query(spark, SF), vc.ORACLE)


def test_labels_of_a_query(spark, tmp_path):
    rows = made(50, 8, 6)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = vc.query(spark, str(tmp_path)).collect()
    label = {i: la for i, _, la in rows}
    for r in got:
        assert r["label_error"] == sum(o["error"] for o in got if label[o["vec_id"]] == label[r["vec_id"]])
    assert len({r["codebooks_sha256"] for r in got}) == 1
