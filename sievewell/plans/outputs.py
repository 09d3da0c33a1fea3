"""Queries of what leaves the screening: verdicts of foreign scorers, copied runs of words, tokens like keys; with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewell.functions import boundary, verdict
from sievewell.operators import scoring, state
from sievewell.plans import screen
from sievewell.sources.tables import messages, table

KEY = "sk-9f86d081884c7d659a2feaa0c55ad015"


def largest(rows: list[dict]) -> list[dict]:
    """The place of the largest of a vector's first 20 components, as a category, which may be out of range; a missing vector raises."""
    out = []
    for r in rows:
        head = list(r["embedding"])[:20]
        i = head.index(max(head))
        out.append({
            "category": i, "severity": i % 6, "confidence": (i * 37 % 60 + 40) / 100.0, "actions": ["suggest_redact"] if i % 2 else ["shout"], "reason_codes": ["NEWS_CONTEXT", "OWN_CODE"] if i % 4 == 0 else ["OWN_CODE"],
            "rationale_id": f"see {KEY}" if i % 11 == 5 else f"nearest_{i}_v1", "model_health": "tokenizer_unavailable" if i % 7 == 3 else None, "counter_updates": [{"counter_id": f"c{i % 3}", "delta": i}],
        })
    return out


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages scored by their document's vector; messages without one fail, each by itself."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("msg_id"), "embedding")
    rows = screen.signals(messages(spark, sf_dir)).join(vectors, "msg_id", "left")
    return scoring.classified(rows, scoring.of_function(largest, ["embedding"]))


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("msg_id", *screen._flat("verdict"), "model_health", F.size("counter_updates").alias("n_updates"))


def _counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    updates = state.valid_updates(scoring.counter_rows(scored(spark, sf_dir), "msg_id", "group_id"))
    return updates.groupBy("group_id", "counter_id").agg(F.sum("delta").alias("total"))


def _health(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("verdict")
    return scored(spark, sf_dir).groupBy("model_health").agg(F.count(F.lit(1)).alias("n"), F.sum(verdict.flagged(v).cast("long")).alias("n_flagged"))


def _words(c: str):
    return F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit(r"[^\x09-\x0D\x20]+"), F.lit(0))


def _copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abstracts that take up to 19 words of their document in a row."""
    d = table(spark, sf_dir, "documents")
    told = d.withColumn("told", F.concat(F.lit("In short: "), F.array_join(F.slice(_words("text"), F.lit(4), (F.col("doc_id") % 20).cast("int")), " ")))
    return told.select("doc_id", boundary.copies(F.col("told"), F.col("text")).alias("copies"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers, and replies that repeat some words of the turn before, against what users said earlier in the conversation."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    replies = c.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.array_join(F.slice(_words("text"), F.lit(3), (F.col("conv_id") % 15 + 1).cast("int")), " ").alias("text"))
    outputs = c.filter("role = 'assistant'").select("conv_id", "turn", "text").unionByName(replies)
    return boundary.echoes(outputs, c.filter("role = 'user'"), ["conv_id"], "turn")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that repeat more than eight words of an earlier document of their source."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    return boundary.echoes(d, d, ["source"], "doc_id")


def _blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.inline(boundary.blobs(F.col("text")))).withColumn("bits", F.round("bits", 4))


QUERIES = {
    "scorer_verdict": _verdicts,
    "scorer_counters": _counters,
    "scorer_health": _health,
    "output_copies": _copies,
    "answer_echo": _answers,
    "echo_documents": _documents,
    "blob_scan": _blobs,
}

# ---- DuckDB SQL ----------------------------------------------------------------------------

_SCORED = f"""WITH {screen.SIGNALS}, placed AS (
  SELECT s.*, list_position(embedding[1:20], list_max(embedding[1:20])) - 1 AS i FROM signals s LEFT JOIN embeddings ON vec_id = msg_id
), stated AS (
  SELECT *, CASE WHEN i % 7 = 3 THEN 'model_unavailable' WHEN i IS NULL OR i > 15 OR i % 11 = 5 THEN 'inference_error' ELSE 'healthy' END AS model_health, coalesce(i <= 15 AND i % 11 <> 5, false) AS fine FROM placed
), given AS (
  SELECT msg_id, group_id, i, model_health, CASE WHEN fine THEN i ELSE 0 END::INTEGER AS category, CASE WHEN fine THEN i % 6 ELSE 0 END::INTEGER AS severity, CASE WHEN fine THEN (i * 37 % 60 + 40) / 100.0::DOUBLE ELSE 0 END::DOUBLE AS confidence,
    '' AS act, fine AND i % 2 = 1 AS redact, NULL::VARCHAR AS resource_link_id,
    list_concat(CASE WHEN i <= 15 AND i % 4 = 0 THEN ['NEWS_CONTEXT'] ELSE []::VARCHAR[] END, CASE WHEN model_health <> 'healthy' THEN list_filter([CASE WHEN len(pii) > 0 THEN 'PRIVATE_DATA_PATTERN' END, CASE WHEN len(scam) > 0 THEN 'SCAM_PATTERN' END,
      CASE WHEN url_risk >= 0.5::DOUBLE THEN 'URL_RISK' END, CASE WHEN len(lex) > 0 THEN 'LEXICON_HIT' END], lambda x: x IS NOT NULL) ELSE []::VARCHAR[] END) AS codes,
    coalesce(CASE WHEN i % 11 <> 5 THEN 'nearest_' || i || '_v1' END, 'model_unavailable_rule_only_v1') AS rationale_id FROM stated
), {screen._policy("given", "1.0::DOUBLE")}, final AS (SELECT *, CASE WHEN i IS NULL OR step IN (2, 3, 4) THEN 0 ELSE 1 END::INTEGER AS n_updates FROM policy)"""
_RUNS = "unnest(list_transform(range(1, len(ws) - 7), lambda i: {'i': i, 'run': array_to_string(ws[i:i + 8], ' ')}))"
_WS = r"regexp_extract_all(coalesce(text, ''), '[^\x09-\x0D\x20]+')"


def _echo(keys: str, at: str) -> str:
    return f"""first AS (SELECT {keys}, r.run AS run, min({at}) AS since FROM (SELECT {keys}, {at}, {_RUNS} AS r FROM heard) GROUP BY ALL)
    SELECT s.{keys}, s.{at}, count(DISTINCT s.r.i) AS copied, min(s.r.i)::INTEGER AS first FROM (SELECT {keys}, {at}, {_RUNS} AS r FROM said) s JOIN first f ON f.{keys} = s.{keys} AND f.run = s.r.run AND since < s.{at} GROUP BY s.{keys}, s.{at}"""


ORACLES = {
    "scorer_verdict": f"{_SCORED} SELECT msg_id, {screen._OUT}, model_health, n_updates FROM final",
    "scorer_counters": f"{_SCORED} SELECT group_id, 'c' || i % 3 AS counter_id, sum(i)::BIGINT AS total FROM final WHERE n_updates = 1 AND group_id <> '' GROUP BY ALL",
    "scorer_health": f"{_SCORED} SELECT model_health, count(*) AS n, sum({screen.FLAGGED}::BIGINT)::BIGINT AS n_flagged FROM final GROUP BY model_health",
    "output_copies": f"""WITH w AS (SELECT doc_id, {_WS} AS ws FROM documents), t AS (SELECT doc_id, ws, list_concat(['In', 'short:'], ws[4:3 + doc_id % 20]) AS told FROM w),
      r AS (SELECT doc_id, list_transform(range(1, len(ws) - 7), lambda i: array_to_string(ws[i:i + 8], ' ')) AS a, list_transform(range(1, len(told) - 7), lambda i: array_to_string(told[i:i + 8], ' ')) AS b FROM t)
      SELECT doc_id, list_has_any(a, b) AS copies FROM r""",
    "answer_echo": f"""WITH c AS (SELECT conv_id, turn, role, {_WS} AS ws FROM conversations), heard AS (SELECT * FROM c WHERE role = 'user'),
    said AS (SELECT conv_id, turn, ws FROM c WHERE role = 'assistant' UNION ALL SELECT conv_id, turn + 1, ws[3:3 + conv_id % 15] FROM heard), {_echo('conv_id', 'turn')}""",
    "echo_documents": f"WITH heard AS (SELECT source, doc_id, {_WS} AS ws FROM documents), said AS (SELECT * FROM heard), {_echo('source', 'doc_id')}",
    "blob_scan": """WITH l AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9+/_=-]{20,}') AS ts FROM documents), t AS (SELECT doc_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS place FROM l),
      c AS (SELECT doc_id, place, t, unnest(string_split(t, '')) AS ch FROM t), n AS (SELECT doc_id, place, t, ch, count(*) AS k FROM c GROUP BY ALL),
      e AS (SELECT doc_id, place, t, length(t) AS length, log2(length(t)) - sum(k * log2(k)) / length(t) AS bits FROM n GROUP BY doc_id, place, t),
      k AS (SELECT *, CASE WHEN regexp_matches(t, '^[0-9a-fA-F]{24,}$') THEN 'hex' WHEN regexp_matches(t, '[0-9]') AND regexp_matches(t, '[A-Za-z]') THEN 'key' END AS kind FROM e)
      SELECT doc_id, place::INTEGER AS place, kind, length::INTEGER AS length, round(bits, 4) AS bits FROM k WHERE kind = 'hex' AND bits >= 2.5 OR kind = 'key' AND bits >= 3.5""",
}
