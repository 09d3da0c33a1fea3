"""Source divergence against a count in plain Python."""

import random
import re
from collections import Counter, defaultdict

from sievewell.llm import divergence


def brute(rows, least, top=50):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in rows]
    df, n, of_lang, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, terms in docs:
        groups.add((lang, source))
        df[lang].update(set(terms))
    for lang, source, terms in docs:
        held = [t for t in terms if df[lang][t] >= least]
        n[lang, source].update(held)
        of_lang[lang].update(held)
    out = []
    for lang, source in groups:
        kept = [t for t in df[lang] if df[lang][t] >= least]

        def p(counter, t):
            return 1 + 10**9 * (counter[t] + 5) // (counter.total() + 5 * len(kept))

        own = n[lang, source]
        pairs = [(sum(abs(p(own, t) - p(n[lang, o], t)) for t in kept), o) for la, o in groups if la == lang and o != source]
        terms = [(p(own, t) - p(of_lang[lang], t), t) for t in kept if own[t] and p(own, t) > p(of_lang[lang], t)]
        for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
            for rank, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                out.append((lang, source, part, item, value, rank))
    return sorted(out)


def run(spark, rows, **options):
    docs = spark.createDataFrame(rows, "lang string, source string, text string").withColumn("n", divergence.F.lit(1)).withColumn("term", divergence.F.lit("x"))
    return sorted(tuple(r) for r in divergence.audit(docs, **options).select("lang", "source", "part", "item", "value", "rank").collect())


def made(seed=3):
    r = random.Random(seed)
    vocabulary = ["the", "The", "été", "Été", "naïve", "straße", "a1b", "x", "日本", "ÀB", *(f"w{chr(97 + i)}" for i in range(20))]
    rows = [(r.choice(["en", "de", None]), r.choice(["a", "b", "c", None, "ü"]), " ".join(r.choices(vocabulary, range(len(vocabulary), 0, -1), k=r.randint(0, 40)))) for _ in range(120)]
    return rows + [("fr", "a", None), ("fr", None, ""), ("fr", "b", "1 2 3"), ("xx", "only", "the the"), *rows[:5], ("en", "a", "long " * 30000)]


def test_equals_a_plain_count(spark):
    rows = made()
    want = brute(rows, 6)
    assert run(spark, rows, least=6) == want and len({r[2] for r in want}) == 2


def test_small_chunks_blocks_and_ranks_change_nothing(spark):
    rows = made(4)
    assert run(spark, rows, least=6, cells=8, block=2) == brute(rows, 6)
    assert run(spark, rows, least=6, top=2) == brute(rows, 6, top=2)


def test_no_rows_and_no_kept_terms(spark):
    assert run(spark, []) == []
    assert run(spark, [("en", "a", "x"), ("en", "b", "y")]) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_shares_are_exact():
    n = [0, 1, 7, 10**12, 3 * 10**15]
    got = divergence.share(divergence.np.array(n), 4 * 10**15, 10**9)
    assert got.tolist() == [1 + 10**9 * (x + 5) // (4 * 10**15 + 5 * 10**9) for x in n]


def test_one_frequent_term_slices(monkeypatch):
    monkeypatch.setattr(divergence, "_STEP", 3)
    assert [t for part in divergence._slices("Äb, CD-e  fé".encode()) for t in part] == ["Äb".encode(), b"cd", b"e", "fé".encode()]
