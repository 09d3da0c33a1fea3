"""Operators on documents: oracles on the small tables, brute force on fixtures, and odd rows."""

import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewell.llm import components, decontam, jaccard, langid, licenses, licensetexts, lmscore, mixing, quality, queries, rules
from sievewell.llm.common import bind, n_words, words
from sievewell.llm.textarrays import shingle_sets, word_hashes
from tests.conftest import SF

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["alpha", "beta", "gamma", "delta", "eins", "zwei", "drei", "uno", "dos", "tres", "the", "of", "und", "de"]


def prose(r, n, sep=" "):
    return sep.join(r.choice(WORDS) + str(r.randint(0, 40)) for _ in range(n))


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], SCHEMA)


ODD = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", "a"), (4, "one", "en", "b"), (4, "one", "en", "b"), (None, "two words", None, "b"), (None, None, "en", None),
    (5, "x " * 30000, "en", "c"), (6, "é" * 5000, "fr", "c"), (7, "\x00\x1f ctrl", "en", "c"), (8, "One  ONE\none", "en", "a"), (9, "x" * 9000, "en", "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and an extra column whose name clashes with inner ones."""
    return documents(spark, ODD).withColumn("score", F.lit("mine")).withColumn("n", F.lit(1)).withColumn("size", F.lit("s"))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd_duck():
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", [list(r) for r in ODD])
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_duckdb(spark, same, name):
    same(queries.QUERIES[name](spark, SF), queries.ORACLES[name])


def test_words_are_those_of_the_pattern(spark):
    texts = [t for _, t, _, _ in ODD] + ["a b c\x0bd\x0ce\rf", "　x"]
    want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").orderBy("i")
    got = df.select(words(F.col("text")), n_words(F.col("text"))).collect()
    assert [g[0] for g in got] == want and [g[1] for g in got] == [len(w) for w in want]
    hashes, offsets = word_hashes(texts, lower=False)
    assert [b - a for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [len(w) for w in want]
    flat = [w for ws in want for w in ws]
    assert len(set(flat)) == len(set(hashes.tolist()))


def test_shingle_sets():
    texts = ["a b c d", "A b C d", "a b", "", None, "x x x x"]
    got = [len(s) for s in shingle_sets(texts, 3)]
    assert got == [2, 2, 1, 0, 0, 1]
    a, b = list(shingle_sets(texts[:2], 3))
    assert (a == b).all()


def test_bind_computes_once(spark):
    assert spark.range(3).select(bind(F.col("id") + 1, lambda x: x * x).alias("v")).agg(F.sum("v")).first()[0] == 14


# ---- rules


def brute_rules(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    wins = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if wins[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_rules_against_brute_force(spark, odd):
    r = random.Random(3)
    rows = [(100 + i, "\n".join(" ".join(r.choices("a b c #x |".split(), k=r.randint(0, 9))) for _ in range(r.randint(1, 6))), "en", "s") for i in range(60)]
    df = documents(spark, rows).unionByName(odd.select(documents(spark, rows).columns))
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = Counter((x["doc_id"], *(x[c] for c in cols)) for x in rules.ledger(df).collect())
    assert got == Counter((i, *brute_rules(t)) for i, t, *_ in [*rows, *ODD])


def test_policies_keep_whole_rows(spark, odd):
    good = documents(spark, [(50, prose(random.Random(1), 80), "en", "a"), (51, ("same line here\n" * 40), "en", "a")]).withColumn("n", F.lit(2)).withColumn("n_words", F.lit("mine"))
    kept = rules.kept(good)
    assert kept.columns == good.columns and [r["doc_id"] for r in kept.collect()] == [50]
    assert rules.kept(odd).count() == 0


def test_ablation(spark):
    led = spark.createDataFrame([(1, 1), (2, 3), (3, 0), (4, 4)], "doc_id long, failed long")
    got = {r["rule"]: (r["n_failed"], r["n_only"]) for r in rules.ablation(led, "web-1").collect()}
    assert got["TOO_FEW_WORDS"] == (2, 1) and got["REPEATED_WORDS"] == (1, 0) and got["SYMBOLS"] == (1, 1)


def test_rules_on_nothing(none):
    assert rules.ledger(none).count() == 0 and rules.kept(none).count() == 0


# ---- mixing


def test_mixing_on_odd_rows(odd, none, odd_duck, same):
    same(mixing.plan(odd).drop("source"), mixing.ORACLE, odd_duck)
    assert mixing.plan(none).count() == 0


def test_mixing_comes_near_its_targets(spark):
    r = random.Random(5)
    rows = [(i, prose(r, r.choice([5, 40, 400])), "en", r.choice(["a", "a", "a", "b", "c", None])) for i in range(300)]
    got = mixing.plan(documents(spark, rows)).collect()
    by = defaultdict(lambda: [0, 0])
    for x in got:
        assert 0 <= x["taken"] <= 2 * x["size"]
        by[x["source"]][0] += x["taken"]
        by[x["source"]][1] = x["target"]
    total = sum(x["size"] for x in got)
    assert abs(sum(t for t, _ in by.values()) - int(1.5 * total)) <= 1
    assert all(abs(t - goal) <= mixing.QUANTUM for t, goal in by.values())
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.plan(documents(spark, rows)).collect()), key=repr)


# ---- Jaccard join


def brute_components(rows, k, num, den):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()

    sets = [(i, shingles(t)) for i, t, *_ in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and den * len(x & y) >= num * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, len(s), d if not s else least.get(find(i))) for i, (d, s) in enumerate(sets))


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_jaccard_join_against_brute_force(spark, k, num):
    r = random.Random(k)
    rows, n = [], 0
    common = prose(r, 60)
    for _ in range(14):
        base = prose(r, r.choice([2, 6, 11, 14, 22, 40, 90])).split()
        for _ in range(r.choice([1, 3, 7])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                at = r.randrange(len(w) + 1)
                w[at : at + 1] = r.choice([["new" + str(r.random())], [], [*w[at : at + 1], "ins" + str(r.random())]])
            rows.append((n, " ".join(w) + (" " + common if r.random() < 0.3 else ""), "en", "s"))
            n += 1
    got = Counter(map(tuple, jaccard.join(documents(spark, rows), k, num, 100).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == brute_components(rows, k, num, 100)


def test_jaccard_join_on_odd_rows(odd, none):
    got = Counter(map(tuple, jaccard.join(odd, 3, 90, 100).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == brute_components(ODD, 3, 90, 100)
    assert jaccard.join(none).count() == 0
    kept = jaccard.deduplicated(odd)
    assert kept.columns == odd.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({1: 1, 2: 1, 3: 1, 4: 1, None: 2, 5: 1, 6: 1, 7: 1, 8: 1, 9: 1})


def test_thresholds_bound_every_linked_pair():
    t = jaccard.Threshold(90, 100)
    for a in range(1, 60):
        for b in range(a, 60):
            for c in range(a + 1):
                if 100 * c >= 90 * (a + b - c):
                    assert c >= t.overlap(a, b) and a >= t.least(b)
                    assert t.overlap(a, b) in t.subset_sizes(a, 60) and t.overlap(a, b) in t.subset_sizes(b, 60)


def test_signatures_never_part_linked_sets():
    r, t = np.random.default_rng(5), jaccard.Threshold(80, 100)
    for n in (1, 3, 40, 700, 60_000):
        whole = r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        for left in range(0, n // 3 + 1, max(1, n // 12)):
            x, y = whole[: n - left // 2], whole[left - left // 2 :]
            common = n - left // 2 - (left - left // 2)
            if 100 * common >= 80 * n:
                near = np.abs(np.frombuffer(jaccard._signature(x), np.uint8).astype(int) - np.frombuffer(jaccard._signature(y), np.uint8)).sum()
                assert near <= t.apart(len(x), len(y)) == len(x) + len(y) - 2 * t.overlap(len(x), len(y))


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (3, 2)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


# ---- decontamination


def test_leaks_are_found_and_clean_documents_left(spark, odd, none):
    r = random.Random(9)
    items = [(i, prose(r, 25) + ". " + prose(r, 8).capitalize() + ".") for i in range(40)]
    rows = [(i, prose(r, r.choice([30, 200])) + (" " + items[i % 40][1] + " " + prose(r, 90) if i % 3 == 0 else ""), "en", "s") for i in range(60)]
    bench = spark.createDataFrame([*items, (99, None), (98, ""), (97, "...")], "item_id long, text string")
    docs = documents(spark, rows)
    got = {(x["doc_id"], x["item_id"]) for x in decontam.contaminated(docs, bench).collect()}
    assert got == {(i, i % 40) for i in range(0, 60, 3)}
    assert {x["doc_id"] for x in decontam.clean(docs, bench).collect()} == {i for i in range(60) if i % 3}
    assert decontam.contaminated(odd, bench).count() == 0 and decontam.clean(odd, bench).columns == odd.columns
    assert decontam.contaminated(none, bench).count() == 0 and decontam.clean(docs, bench.limit(0)).count() == 60


def test_block_max_search_finds_what_brute_force_does():
    r = random.Random(2)
    items = [(i, prose(r, r.randint(3, 30))) for i in range(150)]
    df = Counter(w for _, t in items for w in set(decontam.tokens(t)))
    index = decontam.build(items, df, len(items), 16.0, 30)
    for _ in range(80):
        mine = sorted(index.vocabulary[w] for w in set(decontam.tokens(prose(r, 40))) if w in index.vocabulary)
        scores = defaultdict(float)
        for w in mine:
            for i, x in zip(*index.posting(w)[:2], strict=True):
                scores[i] += x
        want = {i for i, s in scores.items() if s >= 0.3}
        assert {i for i, _ in decontam.search(index, mine, 0.3)} == want



def test_shards_find_the_same(spark):
    r = random.Random(4)
    items = spark.createDataFrame([(i, prose(r, 20)) for i in range(30)], "item_id long, text string")
    texts = [x["text"] + " " + prose(r, 30) for x in items.collect()]
    one, many = decontam.indexes(items), decontam.indexes(items, shard_bytes=1000)
    assert len(one) == 1 and len(many) > 2
    for t in texts:
        found = [{ix.ids[i]: x for ix in group for i, x in decontam.leaks(ix, decontam.tokens(t)).items()} for group in (one, many)]
        assert found[0].keys() == found[1].keys() and len(found[0]) >= 1


def test_passes_lengths_null_and_repeated_ids_find_the_same(spark):
    r = random.Random(12)
    long = prose(r, 700) + ". " + prose(r, 100).capitalize() + "."
    items = [(i, prose(r, 14 + i % 9) + ". " + prose(r, 6).capitalize() + ".") for i in range(60)] + [(None, prose(r, 30)), (3, prose(r, 30)), (2**53 + 1, prose(r, 30)), (70, long)]
    bench = spark.createDataFrame([*items, items[0]], "item_id long, text string").withColumn("cls", F.lit("clash")).withColumn("words", F.lit(1))
    docs = documents(spark, [(i, f"{prose(r, 60)} {t} {prose(r, 60)}", "en", "s") for i, (_, t) in enumerate(items)] + [(500 + k, prose(r, 300), "en", "s") for k in range(10)])
    got = [sorted((x["doc_id"], x["item_id"] is None, x["item_id"], round(x["score"], 9)) for x in decontam.contaminated(docs, bench, pass_bytes=size).collect()) for size in (1, decontam.PASS_BYTES)]
    assert got[0] == got[1] and {x[:3] for x in got[0]} == {(i, k is None, k) for i, (k, _) in enumerate(items)}
    for size in (1, decontam.PASS_BYTES):
        assert {x["doc_id"] for x in decontam.clean(docs, bench, pass_bytes=size).collect()} == {500 + k for k in range(10)}
    halves = {ix.half for ix in decontam.indexes(bench)}
    assert min(halves) == decontam.HALF and max(halves) == 800


def test_an_index_is_small(spark):
    r = random.Random(13)
    texts = [(i, " ".join(f"w{r.randint(0, 30000)}" for _ in range(40))) for i in range(1100)]
    df = Counter(w for _, t in texts for w in set(decontam.tokens(t)))
    size = sum(len(t) for _, t in texts)
    index = decontam.build(texts, df, len(texts), 40.0, 40)
    assert len(index.packed()) < 12 * size and decontam.Index.unpacked(index.packed()).vocabulary == index.vocabulary


def test_near_copies_and_items_without_their_last_sentence_are_leaks(spark):
    r = random.Random(21)
    items = [(i, prose(r, 6 + i) + ". " + prose(r, 2 + i % 7).capitalize() + ".") for i in range(30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    forms = []
    for i, t in items:
        head, last = t[:-1].split(". ")
        words = last.split()
        edited = " ".join([*words[: len(words) // 2], "otherword", *words[len(words) // 2 + 1 :]])
        middle = t.split()
        middle[len(middle) // 2] = "otherword"
        forms.append((i, [t, f"{head}. {edited}.", f"{head}. {edited} added.", " ".join(middle), *([head] if i >= 12 else [])]))
    docs = documents(spark, [(100 * i + k, f"{prose(r, 40)} {f} {prose(r, 40)}", "en", "s") for i, fs in forms for k, f in enumerate(fs)] + [(9000 + k, prose(r, 120), "en", "s") for k in range(60)])
    got = {(x["doc_id"], x["item_id"]) for x in decontam.contaminated(docs, bench).collect()}
    assert got == {(100 * i + k, i) for i, fs in forms for k in range(len(fs))}


# ---- licences


def test_license_forms_are_one(spark, none):
    texts = ["Released under the MIT Licence", "RELEASED  under the \"MIT\" license!", "Copyright (c) 2020 Me\nReleased under the MIT License.", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0", "prose\nAll rights reserved.", "", None]
    docs = documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    got = {(r["doc_id"], r["license_id"], r["scope"]) for r in licenses.scan(docs, licenses.known(spark)).collect()}
    assert got == {(0, "MIT", "line"), (1, "MIT", "line"), (2, "MIT", "line"), (3, "MPL-2.0", "line")}
    isc = next(t for i, s, t in licenses.NOTICES if i == "ISC")
    whole = documents(spark, [(1, "Copyright 2001, A. Person\n\n" + isc.upper(), "en", "s")])
    assert [(r["license_id"], r["scope"]) for r in licenses.scan(whole, licenses.known(spark)).collect()] == [("ISC", "text")]
    assert licenses.scan(none, licenses.known(spark)).count() == 0


def test_whole_licences_and_identifier_lines(spark):
    mit = next(t for i, _, t in licensetexts.TEXTS if i == "MIT")
    texts = ["MIT License\n\nCopyright (c) 2021 Jo\n\n" + mit, " ".join(mit.split()), "// SPDX-License-Identifier: GPL-2.0-or-later\nint x;", "x\n# SPDX-License-Identifier: MIT\ny", mit + " and more"]
    folder = Path("/usr/share/common-licenses")
    files = [("Apache-2.0", "Apache-2.0"), ("GPL-3.0", "GPL-3"), ("MPL-2.0", "MPL-2.0")] if folder.is_dir() else []
    want = {(0, "MIT", "text"), (1, "MIT", "text"), (2, "GPL-2.0", "line"), (3, "MIT", "line")} | {(10 + k, i, "text") for k, (i, _) in enumerate(files)}
    docs = documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)] + [(10 + k, (folder / f).read_text(), "en", "s") for k, (_, f) in enumerate(files)])
    got = {(x["doc_id"], x["license_id"], x["scope"]) for x in licenses.scan(docs, licenses.known(spark)).collect()}
    assert want == {x for x in got if x[0] < 10 or x[2] == "text"}


# ---- language model


def test_scores_on_odd_rows(odd, none, odd_duck, same):
    same(lmscore.scores(odd), lmscore.ORACLE, odd_duck)
    assert lmscore.scores(none).count() == 0


def test_a_small_vocabulary_has_unknown_words(spark):
    r = random.Random(6)
    docs = documents(spark, [(i, prose(r, 50), "en", "s") for i in range(20)])
    got = {x["doc_id"]: x for x in lmscore.scores(docs, vocabulary=50).collect()}
    assert len(got) == 20 and all(x["score"] < 0 and x["n_words"] == 50 for x in got.values())


def test_every_word_keeps_its_own_count(spark):
    r = random.Random(16)
    texts = [prose(r, r.randint(1, 80)) + " the of" * r.randint(0, 3) for _ in range(40)]
    ones, twos = Counter(w for t in texts for w in t.split()), Counter(p for t in texts for p in zip(t.split(), t.split()[1:], strict=False))
    total, want = sum(ones.values()), {}
    for i, t in enumerate(texts):
        ws = t.split()
        logs = [np.log(ones[ws[0]] / total)]
        for p in zip(ws, ws[1:], strict=False):
            logs.append(np.log(twos[p] / ones[p[0]]) if twos[p] >= lmscore.LEAST else np.log(lmscore.BACKOFF * ones[p[1]] / total))
        want[i] = sum(logs) / len(ws)
    docs = documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    for vocabulary in (1, 9, 100, lmscore.VOCABULARY):
        got = {x["doc_id"]: x["score"] for x in lmscore.scores(docs, vocabulary=vocabulary).collect()}
        assert got == pytest.approx(want, abs=2e-6), vocabulary


# ---- learned operators


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in langid._start(3, 1).items()}
    windows, labels = rng.integers(97, 123, (5, 4)), np.array([0, 1, 2, 1])

    def loss(w):
        p = langid._position_probs({k: v.astype(np.float32) for k, v in w.items()}, windows)
        return -np.log(p[:, labels, np.arange(4)]).mean()

    g = langid._gradients({k: v.astype(np.float32) for k, v in w.items()}, windows, labels)
    for k in w:
        at = tuple(rng.integers(0, n) for n in w[k].shape)
        if k[0] == "E":
            at = (at[0], windows[2, 1])
        step = np.zeros_like(w[k])
        step[at] = 2e-2
        rise = (loss({**w, k: w[k] + step}) - loss({**w, k: w[k] - step})) / 4e-2
        assert abs(rise - g[k][at]) < 2e-3, k


def test_language_id(spark, none, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs, ~langid.held_out())
    judged = docs.select("lang", langid.held_out().alias("out"), langid.predicted(model, F.col("text")).alias("p")).filter("out")
    assert judged.filter("lang = p.lang_pred").count() / judged.count() > 0.97
    got = odd.select("doc_id", langid.predicted(model, F.col("text")).alias("p")).select("doc_id", "p.*").collect()
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {None, 1, 2, 3} and all(0 <= r["score"] <= 1 for r in got)
    assert langid.accepted(odd, model).columns == odd.columns
    empty = langid.fit(none, F.lit(True))
    assert {r["lang_pred"] for r in odd.select(langid.predicted(empty, F.col("text")).alias("p")).select("p.*").collect()} == {"und"}


def test_quality_classifier(spark, none, odd):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality.fit(docs, labels, ~quality.held_out())
    judged = docs.join(labels, "doc_id").filter(quality.held_out()).select("quality", quality.score(model, F.col("text")).alias("s"))
    assert judged.filter("(s >= 0.5) = (quality = 1)").count() / judged.count() > 0.95
    got = odd.select(quality.score(model, F.col("text")).alias("s")).collect()
    assert len(got) == len(ODD) and all(0 <= r["s"] <= 1 for r in got)
    nothing = quality.fit(none, labels.limit(0), F.lit(True))
    assert {r["s"] for r in odd.select(quality.score(nothing, F.col("text")).alias("s")).collect()} == {0.5}
