"""Screening of messages: normalize, detect, choose a verdict, apply the policy; and its queries with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievewell.functions import detect, text, verdict
from sievewell.operators.lexicon import Lexicon, lexicon_hits, lexicon_join, lexicon_search
from sievewell.sources.tables import OVERLAYS, SALT, messages, table

LEXICONS = (
    Lexicon("minor_terms", 1, ("zzchildterm",), 0.9),
    Lexicon("insult_terms", 5, ("stupid", "trash"), 0.7),
    Lexicon("hate_terms", 6, ("worthless", "disgusting"), 0.7),
    Lexicon("mild_terms", 0, ("lyanor",), 0.75),
)
NSFW = 0.7


def signals(msgs: DataFrame, lexicons=LEXICONS, registry: detect.Registry | None = None, mode: str = "exact") -> DataFrame:
    """Messages with norm, url_risk, pii, scam, lex and hints; detectors can be replaced by a registry."""
    own = registry or detect.Registry()
    norm = msgs.withColumn("norm", text.normalize_text(F.col("text"), mode))
    n = F.col("norm")
    return norm.withColumns({"url_risk": own.get("url_risk")(n), "pii": own.get("pii")(n), "scam": own.get("scam")(n), "lex": lexicon_hits(n, lexicons), "hints": own.get("context_hints")(F.col("overlay"), F.col("quoted"))})


def screened(msgs: DataFrame, lexicons=LEXICONS, registry: detect.Registry | None = None, mode: str = "exact") -> DataFrame:
    """Messages with all their columns but the text, and `verdict`."""
    s = signals(msgs, lexicons, registry, mode)
    high = F.when(F.col("nsfw") > F.lit(NSFW), F.col("nsfw"))
    raw = verdict.raw_verdict(F.col("url_risk"), F.col("pii"), F.col("scam"), F.col("lex"), high, F.col("hints"))
    kept = [F.col(f"`{c}`") for c in msgs.columns if c not in ("text", "verdict")]
    return s.select(*kept, "hints", raw.alias("_raw")).select(*kept, verdict.policy_verdict(F.col("_raw"), F.map_from_entries("hints")).alias("verdict"))


def screen(msgs: DataFrame, lexicons=LEXICONS, registry: detect.Registry | None = None, mode: str = "exact") -> DataFrame:
    """msg_id, lang, group_id, raw and verdict. No text leaves this step."""
    s = signals(msgs, lexicons, registry, mode)
    high = F.when(F.col("nsfw") > F.lit(NSFW), F.col("nsfw"))
    raw = verdict.raw_verdict(F.col("url_risk"), F.col("pii"), F.col("scam"), F.col("lex"), high, F.col("hints"))
    held = s.select("msg_id", "lang", "group_id", "quoted", "hints", raw.alias("raw"))
    sure = F.map_from_entries("hints")
    return held.select("msg_id", "lang", "group_id", "quoted", "raw", verdict.policy_verdict(F.col("raw"), sure).alias("verdict"))


def _flat(v: str) -> list:
    c = F.col(v)
    return [c["category"].alias("category"), c["severity"].alias("severity"), c["confidence"].alias("confidence"), verdict.action_name(c).alias("actions"), F.array_join(c["reason_codes"], ",").alias("codes"), c["rationale_id"].alias("rationale_id"), c["resource_link_id"].alias("resource_link_id")]


def _joined(c: str, alias: str):
    return F.array_join(c, ",").alias(alias)


# ---- queries -------------------------------------------------------------------------------


def _q(fn):
    return lambda spark, sf_dir: fn(messages(spark, sf_dir))


def _with_hints(msgs: DataFrame) -> DataFrame:
    """Raw verdicts of varied confidences that carry context codes, for the policy's other branches."""
    k = F.col("msg_id")
    conf = F.element_at(F.array(*[F.lit(x) for x in GRID]), (k % len(GRID) + 1).cast("int"))
    code = F.element_at(F.array(*[F.array(*[F.lit(x) for x in xs]).cast("array<string>") for xs in CODES]), (k % len(CODES) + 1).cast("int"))
    cat = F.element_at(F.array(*[F.lit(x) for x in CATS]), (k % len(CATS) + 1).cast("int"))
    acts = verdict.actions("warn", redact=k % 2 == 0)
    v = F.struct(cat.cast("int").alias("category"), F.lit(3).alias("severity"), conf.alias("confidence"), acts.alias("actions"), code.alias("reason_codes"), F.lit("given_v1").alias("rationale_id"), F.lit("link_v1").alias("resource_link_id"))
    sure = F.create_map(F.lit("NEWS_CONTEXT"), F.when(k % 3 == 0, F.lit(0.3)).otherwise(F.lit(0.5)))
    return msgs.select("msg_id", v.alias("raw"), sure.alias("sure"))


GRID = (0.44, 0.45, 0.4499, 0.62, 0.78, 0.85, 0.99)
CODES = ((), ("NEWS_CONTEXT",), ("QUOTED_SPEECH_CONTEXT", "LEXICON_HIT"), ("URL_RISK", "NEWS_CONTEXT", "URL_RISK"), ("LEXICON_HIT",))
CATS = (0, 1, 3, 9)


def tie_break(rows: DataFrame, key: str) -> DataFrame:
    """One verdict of each key: the most severe, then the least category."""
    first = F.struct((-F.col("severity")).alias("severity"), "category")
    return rows.groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(*rows.columns), first).alias("_row")).select("_row.*")  # combined before the shuffle


def _coerce(msgs: DataFrame) -> DataFrame:
    k = F.col("msg_id")
    c = F.when(k % 6 == 0, F.lit("16")).when(k % 6 == 1, F.lit("x")).otherwise((k % 16).cast("string"))
    s, p = (k % 7).cast("string"), (k % 11 / F.lit(10.0)).cast("string")
    codes = F.array(F.lit("URL_RISK"), F.when(k % 2 == 0, F.lit("NOT_A_CODE")).otherwise(F.lit("SCAM_PATTERN")), F.lit("URL_RISK"))
    v = verdict.coerced(c, s, p, codes)
    return msgs.select("msg_id", v.alias("v")).select("msg_id", "v.category", "v.severity", "v.confidence", _joined("v.reason_codes", "codes"), "v.model_health")


def _degraded(msgs: DataFrame) -> DataFrame:
    s = signals(msgs)
    states = ("healthy", "model_unavailable", "tokenizer_unavailable", "dependency_missing", "inference_error", "odd")
    health = F.element_at(F.array(*[F.lit(x) for x in states]), (F.col("msg_id") % 6 + 1).cast("int"))
    s = s.withColumn("health", health)
    v = verdict.degraded_verdict(F.col("health"), F.col("url_risk"), F.col("pii"), F.col("scam"), F.col("lex"))
    return s.select("msg_id", verdict.model_health(F.col("health")).alias("model_health"), v.alias("v")).filter("v IS NOT NULL").select("msg_id", "model_health", _joined("v.reason_codes", "codes"), "v.rationale_id")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many messages of each language get each category and action."""
    s = screen(messages(spark, sf_dir))
    return s.groupBy("lang", F.col("verdict.category").alias("category"), verdict.action_name(F.col("verdict")).alias("actions")).agg(F.count(F.lit(1)).alias("n"))


def _summary(msgs: DataFrame) -> DataFrame:
    names = msgs.sparkSession.createDataFrame(list(enumerate(verdict.TAXONOMY)), "category int, name string")
    counts = screen(msgs).groupBy(F.col("verdict.category").alias("category")).agg(F.count(F.lit(1)).alias("n"), F.sum(verdict.flagged(F.col("verdict")).cast("long")).alias("n_flagged"))
    named = counts.join(names, "category", "left")
    return named.select("category", F.coalesce("name", F.concat(F.lit("CAT_"), F.col("category").cast("string"))).alias("name"), "n", "n_flagged")


def _lexicon_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against the words of the benchmark, a lexicon for each first letter."""
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("token")
    words = table(spark, sf_dir, "benchmark").select(word).distinct()
    letter = F.substring("token", 1, 1)
    tokens = words.select(F.ascii(letter).alias("position"), F.concat(F.lit("words_"), letter).alias("lexicon_id"), (F.ascii(letter) % 16).cast("int").alias("category"), F.lit(0.6).alias("weight"), "token")
    texts = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("norm"))
    return lexicon_search(texts, tokens, "doc_id").select("doc_id", "lexicon_id", "category", "position")


def _lex_rows(msgs: DataFrame) -> DataFrame:
    return lexicon_join(msgs.withColumn("norm", text.normalize_text(F.col("text"))), LEXICONS)


def _lex_top(msgs: DataFrame) -> DataFrame:
    order = Window.partitionBy("msg_id").orderBy(F.desc("weight"), "position")
    return _lex_rows(msgs).withColumn("n", F.row_number().over(order)).filter("n = 1").select("msg_id", "lexicon_id", "category", "weight")


def _media(msgs: DataFrame) -> DataFrame:
    k = F.col("msg_id")
    item = lambda kind, a, b, n: F.struct(kind.alias("kind"), a.cast("double").alias("nsfw_score"), b.cast("double").alias("violence_score"), n.cast("int").alias("face_count"))
    items = F.array(item(F.when(k % 3 == 0, F.lit("video")), k % 5 / F.lit(2.0) - 0.5, F.when(k % 4 == 0, F.lit(0.25)), k % 6 - 2), item(F.lit("sticker"), F.lit(None), F.lit(2.0), F.lit(None)))
    return msgs.select("msg_id", F.explode(detect.media(F.when(k % 9 != 0, items))).alias("m")).select("msg_id", "m.*")


def _packed(msgs: DataFrame) -> DataFrame:
    """The input contract as JSON of four blocks, with defaults filled in."""
    s = signals(msgs)
    message = F.struct(F.length("text").alias("chars"), F.coalesce("lang", F.lit("")).alias("lang_hint"), F.coalesce("quoted", F.lit(False)).alias("quoted_from_user"))
    context = F.struct(F.lit("small_group").alias("group_kind"), F.lit("member").alias("user_role"), F.coalesce("overlay", F.lit("")).alias("community_overlay_id"))
    found = F.struct("url_risk", F.array_join("pii", ",").alias("pii"), F.array_join("scam", ",").alias("scam"))
    limits = F.struct(F.lit(600).alias("max_output_tokens"), F.lit(0.0).alias("temperature"), F.lit("json").alias("output_format"))
    return s.select("msg_id", message.alias("message"), context.alias("context"), found.alias("local_signals"), limits.alias("constraints")).select(
        "msg_id", "message.*", "context.*", "local_signals.*", "constraints.*")


QUERIES = {
    "flagship": flagship,
    "normalize_text": _q(lambda m: m.select("msg_id", F.md5(text.normalize_text(F.col("text"))).alias("norm_md5"))),
    "homoglyph_fold": _q(lambda m: m.select("msg_id", text.homoglyph_fold(F.concat(F.lit("Ѕсаm аρе１２ "), F.col("text"))).alias("folded"))),
    "leet_decode": _q(lambda m: m.select("msg_id", text.leet_decode(F.concat(F.lit("h3ll0 $tup1d @b8 "), F.col("text"))).alias("decoded"))),
    "strip_invisible": _q(lambda m: m.select("msg_id", text.collapse_space(text.strip_invisible(F.concat(F.lit("a​b‮c️  d \t"), F.col("text")))).alias("stripped"))),
    "decode_forms": _q(lambda m: m.select("msg_id", text.decode_forms(F.concat(F.lit("s c​ á m "), F.col("text")), leet=True).alias("f")).select("msg_id", "f.*")),
    "homoglyph_fold_text": _q(lambda m: m.select("msg_id", F.md5(text.homoglyph_fold(F.concat(F.lit("Ѕсаm аρе１２ "), F.col("text")))).alias("folded_md5"))),
    "leet_decode_text": _q(lambda m: m.select("msg_id", F.md5(text.leet_decode(F.concat(F.lit("h3ll0 $tup1d @b8 "), F.col("text")))).alias("decoded_md5"))),
    "strip_invisible_text": _q(lambda m: m.select("msg_id", F.md5(text.collapse_space(text.strip_invisible(F.concat(F.lit("a\u200bb\u202ec\ufe0f  d \t"), F.col("text"))))).alias("stripped_md5"))),
    "token_estimate": _q(lambda m: m.select("msg_id", text.estimate_tokens(F.col("text")).alias("tokens"))),
    "url_extract": _q(lambda m: m.select("msg_id", F.explode(detect.urls(F.col("text"))).alias("url"))),
    "url_risk": _q(lambda m: m.select("msg_id", detect.url_risk(text.normalize_text(F.col("text"))).alias("risk"))),
    "pii_hits": _q(lambda m: signals(m).select("msg_id", _joined("pii", "pii"), F.size("pii").alias("n"))),
    "scam_hits": _q(lambda m: signals(m).select("msg_id", _joined("scam", "scam"), F.size("scam").alias("n"))),
    "media_clamp": _q(_media),
    "context_hints": _q(lambda m: m.select("msg_id", F.explode(detect.context_hints(F.col("overlay"), F.col("quoted"))).alias("h")).select("msg_id", "h.*")),
    "packed_input": _q(_packed),
    "lexicon_hits": _q(_lex_rows),
    "lexicon_index": _lexicon_index,
    "lexicon_semi": _q(lambda m: m.select("msg_id").join(_lex_rows(m).select("msg_id"), "msg_id", "left_semi")),
    "lexicon_top": _q(_lex_top),
    "verdict_raw": _q(lambda m: screen(m).select("msg_id", *_flat("raw"))),
    "policy_verdict": _q(lambda m: screen(m).select("msg_id", *_flat("verdict"))),
    "policy_grid": _q(lambda m: _with_hints(m).select("msg_id", verdict.policy_verdict(F.col("raw"), F.col("sure")).alias("v")).select("msg_id", *_flat("v"))),
    "protected_demotion": _q(lambda m: _with_hints(m).select("msg_id", verdict.policy_verdict(F.col("raw"), F.col("sure")).alias("v")).filter("v.rationale_id = 'safe_protected_speech_v1'").select("msg_id", F.col("v.confidence").alias("confidence"), _joined("v.reason_codes", "codes"))),
    "threshold_tier": _q(lambda m: m.select("msg_id", verdict.tier(F.col("msg_id") % 101 / F.lit(100.0)).alias("tier"))),
    "verdict_coerce": _q(_coerce),
    "verdict_degraded": _q(_degraded),
    "tie_break": _q(lambda m: tie_break(screen(m).select("group_id", "verdict.severity", "verdict.category"), "group_id")),
    "category_summary": _q(_summary),
    "flagged_share": _q(lambda m: screen(m).groupBy("lang").agg(F.round(F.avg(verdict.flagged(F.col("verdict")).cast("double")), 6).alias("share"))),
}

# ---- DuckDB SQL ----------------------------------------------------------------------------

lit = lambda x: "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"
_case = lambda key, xs: f"CASE {key} " + " ".join(f"WHEN {i} THEN {lit(x)}" for i, x in enumerate(xs)) + " END"
_GLYPHS = ", ".join(map(lit, text.HOMOGLYPHS))
_any = lambda parts: "(" + " OR ".join(parts) + ")"
MESSAGES = f"""messages AS (
  SELECT doc_id AS msg_id, text || {_case('doc_id % 8', SALT)} AS text, lang, source AS group_id, {_case('doc_id % 5', OVERLAYS)} AS overlay,
    doc_id % 7 = 0 AS quoted, CASE doc_id % 11 WHEN 0 THEN 0.9::DOUBLE WHEN 1 THEN 0.6::DOUBLE END AS nsfw FROM documents
)"""
_RISK = f"CASE WHEN {_any([f'''ends_with(u, '.{t}') OR contains(u, '.{t}/')''' for t in detect.RISKY_TLDS])} THEN 0.9::DOUBLE WHEN {_any([f'''contains(u, '{w}')''' for w in detect.RISKY_WORDS])} THEN 0.85::DOUBLE ELSE 0.2::DOUBLE END"
_NAMED = lambda ps: "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(norm, {lit(p)}) THEN '{n}' END" for n, p in ps.items()) + "], lambda x: x IS NOT NULL)"
_LEX = "list_filter([" + ", ".join(f"CASE WHEN {_any([f'contains(norm, {lit(t)})' for t in x.tokens])} THEN {{'lexicon_id': '{x.lexicon_id}', 'category': {x.category}, 'weight': {x.weight}::DOUBLE, 'position': {i}}} END" for i, x in enumerate(LEXICONS)) + "], lambda x: x IS NOT NULL)"
_HINTS = "list_filter([" + ", ".join(f"CASE WHEN {_any([f'''contains(lower(coalesce(overlay, '')), '{t}')''' for t in ts])} THEN {{'code': '{c}', 'confidence': 0.5::DOUBLE}} END" for c, ts in detect.CONTEXTS.items()) + ", CASE WHEN quoted THEN {'code': 'QUOTED_SPEECH_CONTEXT', 'confidence': 0.7::DOUBLE} END], lambda x: x IS NOT NULL)"
SIGNALS = f"""{MESSAGES}, normed AS (
  SELECT *, translate(replace(lower(text), 'ß', 'ss'), {_GLYPHS}) AS norm FROM messages
), signals AS (
  SELECT *, coalesce(list_max(list_transform(regexp_extract_all(norm, {lit(detect.URL)}), lambda u: {_RISK})), 0.0::DOUBLE) AS url_risk,
    {_NAMED(detect.PII)} AS pii, {_NAMED(detect.SCAM)} AS scam, {_LEX} AS lex, {_HINTS} AS hints FROM normed
)"""
RAW = f"""{SIGNALS}, ruled AS (
  SELECT *, list_filter(lex, lambda x: x.category = 1) AS child,
    list_filter(lex, lambda x: x.weight = list_max(list_transform(lex, lambda y: y.weight)))[1] AS top, url_risk > 0.8::DOUBLE OR len(scam) > 0 AS scammy FROM signals
), ranked AS (
  SELECT *, CASE WHEN len(child) > 0 THEN 1 WHEN len(pii) > 0 THEN 2 WHEN scammy THEN 3 WHEN len(lex) > 0 AND top.category <> 0 THEN 4 WHEN len(lex) = 0 AND nsfw > {NSFW}::DOUBLE THEN 5 ELSE 6 END AS rule FROM ruled
), raw AS (
  SELECT msg_id, lang, group_id, quoted, hints,
    CASE rule WHEN 1 THEN 1 WHEN 2 THEN 9 WHEN 3 THEN 7 WHEN 4 THEN top.category WHEN 5 THEN 10 ELSE 0 END::INTEGER AS category,
    CASE rule WHEN 1 THEN 5 WHEN 6 THEN 0 ELSE 3 END::INTEGER AS severity,
    CASE rule WHEN 1 THEN greatest(0.45::DOUBLE, least(0.99::DOUBLE, list_max(list_transform(child, lambda x: x.weight)))) WHEN 2 THEN least(0.95::DOUBLE, 0.55::DOUBLE + 0.1::DOUBLE * len(pii))
      WHEN 3 THEN least(0.95::DOUBLE, greatest(url_risk, 0.55::DOUBLE + 0.1::DOUBLE * len(scam))) WHEN 4 THEN greatest(0.45::DOUBLE, least(0.95::DOUBLE, top.weight)) WHEN 5 THEN least(0.95::DOUBLE, nsfw) ELSE 0.05::DOUBLE END AS confidence,
    CASE rule WHEN 1 THEN 'critical_intervention' WHEN 6 THEN '' ELSE 'warn' END AS act, rule = 2 AS redact,
    CASE rule WHEN 1 THEN ['LEXICON_HIT', 'CHILD_SAFETY_FLOOR'] WHEN 2 THEN ['PRIVATE_DATA_PATTERN']
      WHEN 3 THEN list_filter([CASE WHEN url_risk > 0.8::DOUBLE THEN 'URL_RISK' END, CASE WHEN len(scam) > 0 THEN 'SCAM_PATTERN' END], lambda x: x IS NOT NULL)
      WHEN 4 THEN ['LEXICON_HIT'] WHEN 5 THEN [] ELSE list_transform(hints, lambda x: x.code) END AS codes,
    CASE rule WHEN 1 THEN 'child_safety_floor_v1' WHEN 2 THEN 'private_data_pii_v1' WHEN 3 THEN 'scam_credential_phish_v1' WHEN 4 THEN 'lexicon_category_' || top.category || '_v1' WHEN 5 THEN 'sexual_adult_media_v1' ELSE 'safe_benign_v1' END AS rationale_id,
    CASE rule WHEN 1 THEN 'child_safety_resources_v1' END AS resource_link_id
  FROM ranked
)"""
_PROT = "[" + ", ".join(map(lit, verdict.PROTECTED)) + "]"
_TIER = "CASE WHEN confidence >= 0.85::DOUBLE THEN 'critical_intervention' WHEN confidence >= 0.78::DOUBLE THEN 'strong_warn' WHEN confidence >= 0.62::DOUBLE THEN 'warn' WHEN confidence >= 0.45::DOUBLE THEN 'label_only' END"


def _policy(source: str, best: str) -> str:
    """SQL of the policy over a table with category, severity, confidence, act, redact, codes, rationale_id and resource_link_id."""
    return f"""pre AS (
  SELECT *, list_filter(codes, lambda c: list_contains({_PROT}, c)) AS prot, {best} AS best FROM {source}
), chosen AS (
  SELECT *, CASE WHEN category = 1 AND confidence >= 0.45::DOUBLE THEN 1 WHEN category <> 0 AND len(prot) > 0 THEN CASE WHEN best >= 0.5::DOUBLE THEN 2 ELSE 3 END
    WHEN category <> 0 AND confidence < 0.45::DOUBLE THEN 4 WHEN category <> 0 THEN 5 ELSE 6 END AS step FROM pre
), policy AS (
  SELECT * REPLACE (CASE WHEN step IN (2, 4) THEN 0 ELSE category END::INTEGER AS category,
    CASE step WHEN 1 THEN 5 WHEN 2 THEN 0 WHEN 3 THEN least(severity, 2) WHEN 4 THEN 0 ELSE severity END::INTEGER AS severity,
    CASE step WHEN 1 THEN 'critical_intervention' WHEN 2 THEN '' WHEN 3 THEN 'warn' WHEN 4 THEN '' WHEN 5 THEN {_TIER} ELSE act END AS act,
    CASE WHEN step IN (1, 2, 4) THEN false ELSE redact END AS redact,
    CASE step WHEN 1 THEN list_sort(list_distinct(list_append(codes, 'CHILD_SAFETY_FLOOR'))) WHEN 2 THEN list_sort(list_distinct(prot)) WHEN 3 THEN list_sort(list_distinct(list_append(codes, 'WARN_WITH_CONTEXT'))) WHEN 4 THEN [] ELSE codes END AS codes,
    CASE step WHEN 2 THEN 'safe_protected_speech_v1' WHEN 3 THEN 'warn_low_confidence_context_v1' ELSE rationale_id END AS rationale_id,
    CASE WHEN step IN (2, 3, 4) THEN NULL ELSE resource_link_id END AS resource_link_id) FROM chosen
)"""


POLICY = RAW + ", " + _policy("raw", "coalesce(list_max(list_transform(hints, lambda x: x.confidence)), 0.0::DOUBLE)")
POLICY_WITHOUT_MEDIA = "WITH " + POLICY.replace("CASE doc_id % 11 WHEN 0 THEN 0.9::DOUBLE WHEN 1 THEN 0.6::DOUBLE END AS nsfw", "NULL::DOUBLE AS nsfw")
_OUT = "category, severity, confidence, concat_ws('+', nullif(act, ''), CASE WHEN redact THEN 'suggest_redact' END) AS actions, array_to_string(codes, ',') AS codes, rationale_id, resource_link_id"
_list = lambda xs, f=str: "[" + ", ".join(map(f, xs)) + "]"
_dbl = lambda x: f"{x}::DOUBLE"
_GRID = f"""{MESSAGES}, given AS (
  SELECT msg_id, {_list(CATS)}[msg_id % {len(CATS)} + 1] AS category, 3 AS severity, {_list(GRID, _dbl)}[msg_id % {len(GRID)} + 1] AS confidence, 'warn' AS act, msg_id % 2 = 0 AS redact,
    CASE msg_id % {len(CODES)} {" ".join(f"WHEN {i} THEN {_list(xs, lit)}::VARCHAR[]" for i, xs in enumerate(CODES))} END AS codes, 'given_v1' AS rationale_id, 'link_v1' AS resource_link_id FROM messages
), """ + _policy("given", "CASE WHEN list_contains(codes, 'NEWS_CONTEXT') THEN CASE WHEN msg_id % 3 = 0 THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END ELSE 0.0::DOUBLE END")
FLAGGED = "(category <> 0 OR act <> '')"
_INV = lit(r"[\x{AD}\x{200B}-\x{200D}\x{202A}-\x{202E}\x{2060}\x{2066}-\x{2069}\x{FE00}-\x{FE0F}\x{FEFF}\x{E0000}-\x{E007F}]")
ORACLES = {
    "flagship": f"WITH {POLICY} SELECT lang, category, actions, count(*) AS n FROM (SELECT lang, {_OUT} FROM policy) GROUP BY ALL",
    "normalize_text": f"WITH {SIGNALS} SELECT msg_id, md5(norm) AS norm_md5 FROM normed",
    "homoglyph_fold": f"WITH {MESSAGES} SELECT msg_id, translate('Ѕсаm аρе１２ ' || text, {_GLYPHS}) AS folded FROM messages",
    "leet_decode": f"WITH {MESSAGES} SELECT msg_id, translate('h3ll0 $tup1d @b8 ' || text, {', '.join(map(lit, text.LEET))}) AS decoded FROM messages",
    "strip_invisible": f"WITH {MESSAGES} SELECT msg_id, trim(regexp_replace(regexp_replace('a​b‮c️  d \t' || text, {_INV}, '', 'g'), '[{text.WHITE}]+', ' ', 'g')) AS stripped FROM messages",
    "homoglyph_fold_text": f"WITH {MESSAGES} SELECT msg_id, md5(translate('Ѕсаm аρе１２ ' || text, {_GLYPHS})) AS folded_md5 FROM messages",
    "leet_decode_text": f"WITH {MESSAGES} SELECT msg_id, md5(translate('h3ll0 $tup1d @b8 ' || text, {', '.join(map(lit, text.LEET))})) AS decoded_md5 FROM messages",
    "strip_invisible_text": f"WITH {MESSAGES} SELECT msg_id, md5(trim(regexp_replace(regexp_replace('a\u200bb\u202ec\ufe0f  d \t' || text, {_INV}, '', 'g'), '[{text.WHITE}]+', ' ', 'g'))) AS stripped_md5 FROM messages",
    "token_estimate": f"WITH {MESSAGES} SELECT msg_id, ceil(length(text) / 4)::BIGINT AS tokens FROM messages",
    "url_extract": f"WITH {MESSAGES} SELECT msg_id, unnest(regexp_extract_all(text, {lit(detect.URL)})) AS url FROM messages",
    "url_risk": f"WITH {SIGNALS} SELECT msg_id, url_risk AS risk FROM signals",
    "pii_hits": f"WITH {SIGNALS} SELECT msg_id, array_to_string(pii, ',') AS pii, len(pii)::INTEGER AS n FROM signals",
    "scam_hits": f"WITH {SIGNALS} SELECT msg_id, array_to_string(scam, ',') AS scam, len(scam)::INTEGER AS n FROM signals",
    "media_clamp": f"""WITH {MESSAGES} SELECT msg_id, coalesce(CASE WHEN msg_id % 3 = 0 THEN 'video' END, 'image') AS kind, greatest(0, least(1, msg_id % 5 / 2.0::DOUBLE - 0.5::DOUBLE))::DOUBLE AS nsfw_score,
      CASE WHEN msg_id % 4 = 0 THEN 0.25::DOUBLE END AS violence_score, greatest(0, msg_id % 6 - 2)::INTEGER AS face_count FROM messages WHERE msg_id % 9 <> 0
      UNION ALL SELECT msg_id, 'sticker', NULL, 1.0::DOUBLE, NULL FROM messages WHERE msg_id % 9 <> 0""",
    "context_hints": f"WITH {SIGNALS} SELECT msg_id, h.code AS code, h.confidence AS confidence FROM (SELECT msg_id, unnest(hints) AS h FROM signals)",
    "packed_input": f"""WITH {SIGNALS} SELECT msg_id, length(text)::INTEGER AS chars, coalesce(lang, '') AS lang_hint, coalesce(quoted, false) AS quoted_from_user, 'small_group' AS group_kind, 'member' AS user_role,
      coalesce(overlay, '') AS community_overlay_id, url_risk, array_to_string(pii, ',') AS pii, array_to_string(scam, ',') AS scam, 600::INTEGER AS max_output_tokens, 0.0::DOUBLE AS temperature, 'json' AS output_format FROM signals""",
    "lexicon_hits": f"WITH {SIGNALS} SELECT msg_id, h.lexicon_id AS lexicon_id, h.category::INTEGER AS category, h.weight AS weight, h.position::INTEGER AS position FROM (SELECT msg_id, unnest(lex) AS h FROM signals)",
    "lexicon_index": """WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS token FROM benchmark)
      SELECT DISTINCT doc_id, 'words_' || token[1] AS lexicon_id, ascii(token) % 16 AS category, ascii(token) AS position FROM documents JOIN t ON contains(lower(text), token)""",
    "lexicon_semi": f"WITH {SIGNALS} SELECT msg_id FROM signals WHERE len(lex) > 0",
    "lexicon_top": f"WITH {RAW} SELECT msg_id, top.lexicon_id AS lexicon_id, top.category::INTEGER AS category, top.weight AS weight FROM ruled WHERE len(lex) > 0",
    "verdict_raw": f"WITH {RAW} SELECT msg_id, {_OUT} FROM raw",
    "policy_verdict": f"WITH {POLICY} SELECT msg_id, {_OUT} FROM policy",
    "policy_grid": f"WITH {_GRID} SELECT msg_id, {_OUT} FROM policy",
    "protected_demotion": f"WITH {_GRID} SELECT msg_id, confidence, array_to_string(codes, ',') AS codes FROM policy WHERE step = 2",
    "threshold_tier": f"WITH {MESSAGES} SELECT msg_id, {_TIER} AS tier FROM (SELECT msg_id, msg_id % 101 / 100.0::DOUBLE AS confidence FROM messages)",
    "verdict_coerce": f"""WITH {MESSAGES}, v AS (
      SELECT msg_id, TRY_CAST(CASE msg_id % 6 WHEN 0 THEN '16' WHEN 1 THEN 'x' ELSE (msg_id % 16)::VARCHAR END AS INTEGER) AS c, (msg_id % 7)::INTEGER AS s, msg_id % 11 / 10.0::DOUBLE AS p FROM messages
    ), w AS (SELECT *, coalesce(c BETWEEN 0 AND 15 AND s BETWEEN 0 AND 5 AND p BETWEEN 0 AND 1, false) AS good FROM v)
    SELECT msg_id, CASE WHEN good THEN c ELSE 0 END::INTEGER AS category, CASE WHEN good THEN s ELSE 0 END::INTEGER AS severity, CASE WHEN good THEN p ELSE 0 END::DOUBLE AS confidence,
      CASE WHEN NOT good THEN '' WHEN msg_id % 2 = 0 THEN 'URL_RISK' ELSE 'URL_RISK,SCAM_PATTERN' END AS codes, CASE WHEN good THEN 'healthy' ELSE 'inference_error' END AS model_health FROM w""",
    "verdict_degraded": f"""WITH {SIGNALS} SELECT msg_id, CASE WHEN msg_id % 6 = 4 THEN 'inference_error' ELSE 'model_unavailable' END AS model_health,
      array_to_string(list_filter([CASE WHEN len(pii) > 0 THEN 'PRIVATE_DATA_PATTERN' END, CASE WHEN len(scam) > 0 THEN 'SCAM_PATTERN' END, CASE WHEN url_risk >= 0.5::DOUBLE THEN 'URL_RISK' END, CASE WHEN len(lex) > 0 THEN 'LEXICON_HIT' END], lambda x: x IS NOT NULL), ',') AS codes,
      '{verdict.DEGRADED}' AS rationale_id FROM signals WHERE msg_id % 6 <> 0""",
    "tie_break": f"WITH {POLICY} SELECT group_id, severity, category FROM policy QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY severity DESC, category) = 1",
    "category_summary": f"WITH {POLICY} SELECT category, coalesce({_list(verdict.TAXONOMY, lit)}[category + 1], 'CAT_' || category) AS name, count(*) AS n, sum({FLAGGED}::BIGINT)::BIGINT AS n_flagged FROM policy GROUP BY category",
    "flagged_share": f"WITH {POLICY} SELECT lang, round(avg({FLAGGED}::INTEGER), 6) AS share FROM policy GROUP BY lang",
}
