import hashlib
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from sievewell.functions import detect, text, verdict
from sievewell.operators import lexicon, packs, state


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


def test_exact_normalization_is_pythons(spark):
    texts = ["Straße", "ＡＢＣ１", "Ѕсаm", "ﬁne", "é", "", None, "ΑΒ", "İ"]
    table = str.maketrans(*text.HOMOGLYPHS)
    want = [t if t is None else unicodedata.normalize("NFKC", t).casefold().translate(table) for t in texts]
    assert column(spark, texts, lambda c: text.normalize_text(c, "exact")) == want


def test_sql_normalization_is_exact_on_plain_text(spark):
    texts = ["Grüße Straße", "plain TEXT", "ñandú"]
    assert column(spark, texts, lambda c: text.normalize_text(c, "sql")) == column(spark, texts, lambda c: text.normalize_text(c, "exact"))


# The patterns whose matches the portable forms must have.
PYTHON = {
    "EMAIL": r"[\w.+-]+@[\w-]+\.[\w.-]+", "PHONE": r"(?<!\w)\+?\d[\d\-\s().]{7,}\d(?!\w)", "CREDIT_CARD": r"(?<!\d)(?:\d[ -]?){13,19}(?!\d)",
}


@pytest.mark.parametrize("name", sorted(PYTHON))
def test_portable_patterns_agree_with_lookaround(spark, name):
    r = random.Random(name)
    texts = ["".join(r.choices("a@.+-_ é()12345678\n", k=r.randint(0, 30))) for _ in range(2000)]
    texts += ["".join(r.choices("0123456789 -", k=r.randint(8, 24))) for _ in range(1000)]
    assert column(spark, texts, lambda c: c.rlike(detect.PII[name])) == [bool(re.search(PYTHON[name], t)) for t in texts]


def test_link_risk(spark):
    risks = {"none": 0.0, "http://a.example": 0.2, "see http://a.zip": 0.9, "http://a.zip/x": 0.9, "http://a.zip?x": 0.2, "http://a.zip,": 0.2, "www.loginov.example": 0.85, "http://a.example http://b.top/": 0.9, "www.a": 0.0}
    assert column(spark, list(risks), detect.url_risk) == list(risks.values())


def test_scam_patterns_stop_at_line_ends(spark):
    texts = ["deposit the fee", "deposit\nfee", "wire a fee", "wirefee", "CONFIRM your LOGIN", "you  have won", "youwon"]
    assert column(spark, texts, lambda c: F.array_join(detect.scam_hits(c), ",")) == ["ADVANCE_FEE", "", "ADVANCE_FEE", "", "CREDENTIAL_HARVEST", "FAKE_GIVEAWAY", ""]


def test_tiers(spark):
    got = column(spark, [0.44, 0.45, 0.4499, 0.62, 0.78, 0.85, 0.55 + 0.1 * 3, 0.99], verdict.tier, "double")
    assert got == [None, "label_only", None, "warn", "strong_warn", "critical_intervention", "critical_intervention", "critical_intervention"]


def test_child_safety_below_the_threshold_can_be_demoted(spark):
    v = F.struct(F.lit(1).alias("category"), F.lit(5).alias("severity"), F.col("v").alias("confidence"), verdict.actions().alias("actions"), F.array(F.lit("NEWS_CONTEXT")).alias("reason_codes"), F.lit("r").alias("rationale_id"), F.lit("l").alias("resource_link_id"))
    assert column(spark, [0.44, 0.45], lambda c: verdict.policy_verdict(v)["category"], "double") == [0, 1]


def test_verdicts_carry_no_text(spark):
    from sievewell.plans.screen import screen
    from sievewell.sources.tables import messages
    from tests.conftest import SF

    assert set(screen(messages(spark, SF)).columns) == {"msg_id", "lang", "group_id", "quoted", "raw", "verdict"}


def test_registered_detectors_replace_built_in(spark):
    own = detect.Registry(url_risk=lambda c: F.lit(0.9))
    own.register("extra", lambda c: c)
    assert "extra" in own.kinds() and own.get("pii") is detect.pii_hits
    assert column(spark, ["x"], own.get("url_risk")) == [0.9]


def test_lexicon_literal_and_joined_forms_agree(spark):
    lexicons = [lexicon.Lexicon("a", 5, ("foo", ""), 0.7), lexicon.Lexicon("b", 6, ("oba", "zz"), 0.7), lexicon.Lexicon("none", 3, ())]
    df = spark.createDataFrame([(1, "foobar"), (2, "x"), (3, "foo zz"), (4, None)], "msg_id long, norm string")
    joined = {(r["msg_id"], r["lexicon_id"]) for r in lexicon.lexicon_join(df, lexicons).collect()}
    literal = {(r[0], h["lexicon_id"]) for r in df.select("msg_id", lexicon.lexicon_hits(F.col("norm"), lexicons)).collect() for h in r[1]}
    assert joined == literal == {(1, "a"), (1, "b"), (3, "a"), (3, "b")}


def test_trailing_window_is_inclusive(spark):
    rows = [(1, "g", "c", "2024-01-01 00:00:00", 1), (2, "g", "c", "2024-01-01 00:00:10", 2), (3, "g", "c", "2024-01-01 00:00:10.000001", 4)]
    df = spark.createDataFrame(rows, "event_id int, group_id string, counter_id string, t string, delta int").withColumn("ts", F.to_timestamp("t"))
    assert {r["event_id"]: r["count"] for r in state.trailing(df, 10).collect()} == {1: 1, 2: 3, 3: 6}


def test_versions(spark):
    got = column(spark, ["1.10", "1.9b.x", "v2", ""], packs.version_key)
    assert got == [[1, 10], [1, 9, 0], [0], [0]]
    assert column(spark, ["1.10", "1.9", "1.9.0"], lambda c: packs.at_least(c, F.lit("1.9.0"))) == [True, True, True]


def test_decoders(spark):
    forms = column(spark, ["s c​ a m", "fr33 m0n3y"], lambda c: text.decode_forms(c, leet=True)["closed"])
    assert forms == ["scam", "freemoney"]


def test_queries_read_whole_texts(spark, tmp_path):
    from sievewell.plans import screen

    tail = "Ѕсаm h3ll0 a\u200bb p á y " * 3
    texts = ["plain words of some length " + tail + str(i) for i in range(3)]
    spark.createDataFrame([(7 + 8 * i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["msg_id"]: r for r in screen.QUERIES["decode_forms"](spark, str(tmp_path)).collect()}
    glyphs, leet = str.maketrans(*text.MORE_HOMOGLYPHS), str.maketrans(*text.LEET)
    for i, t in enumerate(texts):
        plain = "".join(c for c in unicodedata.normalize("NFKD", "s c á m " + t.replace("\u200b", "")) if not unicodedata.combining(c)).lower().translate(glyphs).translate(leet)
        assert got[7 + 8 * i]["spaced"] == " ".join(plain.split())
    for name, want in {
        "homoglyph_fold_text": ["Ѕсаm аρе１２ " + t for t in texts], "leet_decode_text": ["h3ll0 $tup1d @b8 " + t for t in texts], "strip_invisible_text": ["abc d " + t.replace("\u200b", "") for t in texts],
    }.items():
        if name == "strip_invisible_text":
            want = [" ".join(t.split()) for t in want]
        else:
            want = [t.translate(str.maketrans(*text.HOMOGLYPHS) if name[0] == "h" else leet) for t in want]
        rows = screen.QUERIES[name](spark, str(tmp_path)).collect()
        assert {r[0]: r[1] for r in rows} == {7 + 8 * i: hashlib.md5(t.encode()).hexdigest() for i, t in enumerate(want)}, name


def test_disguised_messages_are_seen(spark, tmp_path):
    from sievewell.plans import screen

    def wide(t):
        return "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in t)

    def bold(t):
        return "".join(chr(0x1D41A + ord(c) - 97) if c.isascii() and c.islower() else c for c in t)

    plain = ["such a stupid thing", "mail jo@example.org today", "see http://files.example.zip/a", "congratulations you have won", "confirm now with your password", "a fine day"]
    forms = [plain, [wide(t) for t in plain], [bold(t) for t in plain], [t.replace("fi", "ﬁ") for t in plain]]
    rows = [(7 + 8 * (10 * k + i), t, "en", "s") for k, ts in enumerate(forms) for i, t in enumerate(ts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    table = str.maketrans(*text.HOMOGLYPHS)
    want = {i: hashlib.md5(unicodedata.normalize("NFKC", t).casefold().translate(table).encode()).hexdigest() for i, t, *_ in rows}
    assert {r[0]: r[1] for r in screen.QUERIES["normalize_text"](spark, str(tmp_path)).collect()} == want
    for name in ("lexicon_hits", "pii_hits", "url_risk", "scam_hits"):
        got = [set() for _ in forms]
        for r in screen.QUERIES[name](spark, str(tmp_path)).collect():
            k, i = divmod(r["msg_id"] // 8, 10)
            got[k].add((i, *(x for c, x in r.asDict().items() if c != "msg_id")))
        assert len(set(map(frozenset, got))) == 1 and got[0], name


def test_head_learns_from_vectors(spark):
    from sievewell.operators import vectors

    rows = [([1.0, 0.1 * i], 0) for i in range(5)] + [([-1.0, 0.1 * i], 1) for i in range(3)]
    df = spark.createDataFrame(rows, "embedding array<double>, label int")
    assert vectors.train_head(df).summary.accuracy == 1.0


def test_invisible_characters(spark):
    gone = [0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, *range(0x202A, 0x202F), *range(0x2066, 0x206A), 0xFE00, 0xFE0F, 0xE0000, 0xE0041, 0xE007F]
    kept = [0x200E, 0x200F, 0x180E, 0x2065, 0x206A, 0xFE10, 0xAC, 0xAE]
    assert column(spark, ["a" + chr(c) + "b" for c in gone], text.strip_invisible) == ["ab"] * len(gone)
    assert column(spark, ["a" + chr(c) + "b" for c in kept], text.strip_invisible) == ["a" + chr(c) + "b" for c in kept]


def test_windows_need_a_unit_that_fits(spark):
    specs = {"24h": 86400, "7D": 604800, "45s": 45, "0m": 0, "90": None, "h": None, "": None, None: None, "-1h": None, "1w": None, "9" * 30 + "s": None, "9" * 18 + "d": None}
    assert column(spark, list(specs), state.parse_window) == list(specs.values())


def test_an_empty_counter_rejects_its_batch(spark):
    rows = [(1, "g", "c", 1), (1, "g", "", 1), (2, "g", "c", 1), (3, "", "c", 1), (4, "g", "c", None), (5, None, "c", 1), (6, "g", "d", -1)]
    got = state.valid_updates(spark.createDataFrame(rows, "batch_id int, group_id string, counter_id string, delta int"))
    assert sorted(r["batch_id"] for r in got.collect()) == [2, 6]


def test_longer_versions(spark):
    assert column(spark, ["1.2.0.0.1", "1.2", "1.2.0.0.2"], lambda c: packs.at_least(c, F.lit("1.2.0.0.1"))) == [True, False, True]


def resolved(spark, rows):
    rules = spark.createDataFrame(rows, "layer string, block string, category int, floor int, action string")
    return {r["category"]: (r["severity_floor"], r["action"], r["source"]) for r in packs.resolve(rules).collect()}


def test_child_safety_is_always_pinned(spark):
    child = {1: (5, "critical_intervention", "baseline")}
    assert resolved(spark, []) == child
    assert resolved(spark, [("community", "rules", 1, None, "label_only"), ("baseline", "overrides", 9, 4, None), ("community", "rules", None, None, "warn")]) == child


def test_layers_fold(spark):
    rows = [
        ("jurisdiction", "overrides", 4, 4, "block"), ("community", "overrides", 4, 1, None), ("jurisdiction", "rules", 9, 5, None), ("community", "rules", 7, None, "label_only"), ("jurisdiction", "overrides", 7, 3, None),
        ("community", "rules", 13, None, "howl"), ("jurisdiction", "rules", 13, None, "shout"), ("community", "rules", 14, None, "howl"),
    ]
    want = {
        4: (4, "strong_warn", "jurisdiction"), 9: (0, "warn", "jurisdiction"), 7: (3, "warn", "community"), 13: (0, "label_only", "community"), 14: (0, "howl", "community"), 1: (5, "critical_intervention", "baseline"),
    }
    assert resolved(spark, rows) == want


def test_any_privacy_rule_of_an_overlay_is_reported(spark):
    base, over = (spark.createDataFrame(x, "rule_id string, rule string") for x in ([("p1", "a"), ("p2", "b")], [("p2", "b"), ("p9", "new")]))
    assert sorted(map(tuple, packs.privacy_intact(base, over).collect())) == [("p2", "b", "b"), ("p9", "new", None)]
    assert packs.privacy_intact(base, over.filter("false")).count() == 0


def test_recent_appeals_include_the_bound(spark):
    rows = [(1, "2024-01-08 00:00:00"), (2, "2024-01-01 00:00:00"), (3, "2023-12-31 23:59:59.999999"), (4, None), (5, "2024-02-01 00:00:00")]
    df = spark.createDataFrame(rows, "i int, t string").withColumn("ts", F.to_timestamp("t"))
    now = F.to_timestamp(F.lit("2024-01-08 00:00:00"))
    assert sorted(r["i"] for r in state.recent(df, now, 7).collect()) == [1, 2, 5]
    with pytest.raises(ValueError):
        state.recent(df, now, 0)


def test_head_scores_are_a_softmax(spark):
    import numpy as np

    from sievewell.operators import vectors

    heads = [(0, [1.0, 0.5], 0.1), (1, [-2.0, 3.0], -0.2), (2, [0.0, 900.0], 0.0)]
    rows = [(1, [0.3, 0.2]), (1, [1.0, -1.0]), (2, [0.0, 0.0]), (3, None)]
    got = vectors.head_scores(spark.createDataFrame(rows, "vec_id int, embedding array<double>"), spark.createDataFrame(heads, "label int, weights array<double>, bias double"))
    want = []
    for i, v in rows[:3]:
        z = np.array([np.dot(v, w) + b for _, w, b in heads])
        e = np.exp(z - z.max())
        want += [(i, k, round(float(z[k]), 9), round(float(e[k] / e.sum()), 9)) for k in range(3)]
    assert sorted((r["vec_id"], r["label_id"], round(r["logit"], 9), round(r["p"], 9)) for r in got.collect() if r["vec_id"] < 3) == sorted(want)
    assert all(r["p"] is None for r in got.filter("vec_id = 3").collect())


def test_prototypes_without_labels_score_nothing(spark):
    from sievewell.operators import vectors

    df = spark.createDataFrame([(1, [1.0, 0.0], None), (2, [0.0, 2.0], None)], "vec_id long, embedding array<double>, label int")
    none = vectors.prototypes(df)
    assert vectors.scores(df, none).count() == 0 and vectors.verdicts(df, none).count() == 0
    one = vectors.prototypes(df.withColumn("label", F.lit(3)))
    assert {r["vec_id"]: r["category"] for r in vectors.verdicts(df, one).collect()} == {1: 3, 2: 3}
