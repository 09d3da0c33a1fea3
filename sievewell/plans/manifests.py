"""Queries of compiled manifests: packs as JSON derived from nations and suppliers, a bundle for each customer; with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewell.functions.verdict import TAXONOMY
from sievewell.operators import manifest, packs
from sievewell.sources import openpacks
from sievewell.sources.tables import table

INSTRUCTION = "Judge only what is given.\nAnswer as JSON.\n"
_TWO = packs.CONTEXTS[:2]


def _named(rows: DataFrame, key: str, wanted: DataFrame | None) -> DataFrame:
    """The rows that are to be opened; a key is wanted before its pack is parsed, not after."""
    return rows if wanted is None else rows.join(wanted, rows[key] == wanted[wanted.columns[0]], "left_semi")


def jurisdictions(spark: SparkSession, sf_dir: str, wanted: DataFrame | None = None) -> DataFrame:
    """Jurisdictions of all nations, or of those whose keys are the column of `wanted`."""
    k, number = F.col("n_nationkey"), lambda x: x.cast("int")
    over = F.transform(F.sequence(F.lit(0), number(k % 4)), lambda i: F.struct((i * 7 + k).cast("int").alias("category"), F.when(k % 3 != 0, number((k + i) % 6)).alias("severity_floor")))
    contexts = F.transform(F.sequence(F.lit(1), number(k % 6 + 1)), lambda i: F.concat(F.col("n_name"), F.lit("_CONTEXT_"), (i % 4).cast("string")))
    doc = F.to_json(F.struct(F.concat(F.lit("jurisdiction."), k.cast("string")).alias("skill_id"), F.when(k % 5 != 0, over).alias("overrides"), F.when(k % 7 != 0, contexts).alias("allowed_contexts")))
    return openpacks.opened(_named(table(spark, sf_dir, "nation"), "n_nationkey", wanted).select(k.alias("id"), doc.alias("text")), manifest.FIELDS, ("skill_id",))


def communities(spark: SparkSession, sf_dir: str, wanted: DataFrame | None = None) -> DataFrame:
    """Communities with up to 260 rules, so that some are beyond the budget; of all suppliers, or of those whose keys are the column of `wanted`."""
    k, number = F.col("s_suppkey"), lambda x: x.cast("int")
    rule = lambda i: F.struct(((i + k) % 18).cast("int").alias("category"), F.when(i % 3 != 0, F.lit("strong_warn")).alias("action"), F.when(i % 2 == 0, F.lit(True)).alias("suggest_redact"), F.when(i % 5 == 0, F.lit(False)).alias("suggest_mute"))
    rules = F.filter(F.transform(F.sequence(F.lit(0), number(k * 13 % 260)), rule), lambda r: r.isNotNull())
    none = F.lit(None).cast("int")
    levels = F.struct(number(k % 4).alias("label_at"), F.when(k % 2 == 0, number(k % 4 + 2)).alias("strong_label_at"), F.when(k % 5 != 0, number(k % 4 + 5)).alias("escalate_at"))
    counters = F.array(F.struct(F.concat(F.lit("c"), k.cast("string")).alias("counter_id"), levels.alias("thresholds")), F.struct(F.lit("other").alias("counter_id"), F.struct(none.alias("label_at"), none.alias("strong_label_at"), F.lit(9).alias("escalate_at")).alias("thresholds")))
    doc = F.to_json(F.struct(
        F.concat(F.lit("community."), k.cast("string")).alias("skill_id"), F.struct(F.when(k % 3 == 0, F.lit("minor_present")).alias("age_mode")).alias("community_profile"),
        F.when(k % 6 != 0, rules).alias("rules"), F.when(k % 4 != 0, counters).alias("group_risk_counters"), F.when(k % 2 == 0, F.array(F.lit("NEWS_CONTEXT"), F.lit("OWN_CONTEXT"))).alias("allowed_contexts")))
    return openpacks.opened(_named(table(spark, sf_dir, "supplier"), "s_suppkey", wanted).select(k.alias("id"), doc.alias("text")), manifest.FIELDS, ("skill_id",))


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("bundle"), F.when(k % 9 != 0, F.col("c_nationkey")).alias("_j"), F.when(k % 8 != 0, k % 13).alias("_c"))


def _manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest for each pair of packs that some customer has, its `bundle`. Packs no customer has are not opened."""
    pairs = _customers(spark, sf_dir).select("_j", "_c").distinct()
    key = lambda c: pairs.select(c).filter(F.col(c).isNotNull()).distinct()
    as_struct = lambda df, key, name: df.select(F.col("id").alias(key), F.struct(*manifest.FIELDS).alias(name))
    packed = pairs.join(as_struct(jurisdictions(spark, sf_dir, key("_j")), "_j", "jurisdiction"), "_j", "left").join(as_struct(communities(spark, sf_dir, key("_c")), "_c", "community"), "_c", "left")
    return manifest.compiled(packed.select(F.struct("_j", "_c").alias("bundle"), "jurisdiction", "community"), INSTRUCTION, _TWO)


def _to_customers(spark: SparkSession, sf_dir: str, rows: DataFrame, pair: str, name: str) -> DataFrame:
    """Rows of a pair of packs as rows of each customer that has it."""
    of, at = _customers(spark, sf_dir), F.col(pair)
    both = rows.withColumns({"_pj": at["_j"], "_pc": at["_c"]}).drop(pair)
    joined = of.withColumnRenamed("bundle", name).join(both, F.col("_j").eqNullSafe(F.col("_pj")) & F.col("_c").eqNullSafe(F.col("_pc")))
    return joined.drop("_j", "_c", "_pj", "_pc")


def _compiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _manifests(spark, sf_dir).select("bundle", F.md5("text").alias("text_md5"), "tokens", "problem")
    return _to_customers(spark, sf_dir, made, "bundle", "bundle").select("bundle", "text_md5", "tokens", "problem")


def _read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compiled manifests cut at their marks again."""
    texts = _manifests(spark, sf_dir).filter("text IS NOT NULL").select(F.col("bundle").alias("manifest"), "text")
    cut = packs.sections(texts).filter("section IN ('JURISDICTION_OVERLAY', 'COMMUNITY_OVERLAY')").select("manifest", "section", F.md5("text").alias("text_md5"))
    return _to_customers(spark, sf_dir, cut, "manifest", "manifest").select("manifest", "section", "text_md5")


QUERIES = {
    "manifest_compile": _compiled,
    "manifest_read_back": _read_back,
    "community_counters": lambda s, d: manifest.community_counters(communities(s, d)),
}

_NAMES = "[" + ", ".join(f"'{n}'" for n in TAXONOMY) + "]"
_CAT = f"'  - category ' || cat || ' ' || coalesce({_NAMES}[cat + 1], 'CAT_' || cat)"
_LINES = f"""WITH o AS (
  SELECT jid, string_agg(chr(10) || {_CAT} || ' severity_floor ' || CASE WHEN jid % 3 <> 0 THEN (jid + i) % 6 ELSE 0 END, '' ORDER BY i) AS lines
  FROM (SELECT jid, i, i * 7 + jid AS cat FROM (SELECT n_nationkey AS jid, unnest(range(n_nationkey % 4 + 1)) AS i FROM nation)) GROUP BY jid
), j AS (
  SELECT jid, 'id: jurisdiction.' || jid || chr(10) || 'overrides:' || CASE WHEN jid % 5 <> 0 THEN lines ELSE '' END AS jtext,
    CASE WHEN jid % 7 <> 0 THEN list_transform(range(1, jid % 6 + 2), lambda i: n_name || '_CONTEXT_' || i % 4) ELSE [] END AS jcontexts FROM nation JOIN o ON jid = n_nationkey
)"""
_WHOLE = f"""{_LINES}, r AS (
  SELECT s_suppkey AS cid, string_agg(chr(10) || {_CAT} || ' action=' || CASE WHEN i % 3 <> 0 THEN 'strong_warn' ELSE 'warn' END || CASE WHEN i % 2 = 0 THEN ' suggest_redact=true' ELSE '' END, '' ORDER BY i) AS rules
  FROM (SELECT s_suppkey, i, (i + s_suppkey) % 18 AS cat FROM (SELECT s_suppkey, unnest(range(s_suppkey * 13 % 260 + 1)) AS i FROM supplier)) GROUP BY s_suppkey
), c AS (
  SELECT cid, 'id: community.' || cid || CASE WHEN cid % 3 = 0 THEN chr(10) || 'age_mode: minor_present' ELSE '' END || CASE WHEN cid % 6 <> 0 THEN chr(10) || 'rules:' || rules ELSE '' END
    || CASE WHEN cid % 4 <> 0 THEN chr(10) || 'counters:' || chr(10) || '  - c' || cid || ' thresholds ' || (cid % 4) || '/' || CASE WHEN cid % 2 = 0 THEN (cid % 4 + 2)::VARCHAR WHEN cid % 5 <> 0 THEN (cid % 4 + 5)::VARCHAR ELSE '?' END
      || '/' || CASE WHEN cid % 5 <> 0 THEN (cid % 4 + 5)::VARCHAR ELSE '?' END || chr(10) || '  - other thresholds ?/9/9' ELSE '' END AS ctext,
    CASE WHEN cid % 2 = 0 THEN ['NEWS_CONTEXT', 'OWN_CONTEXT'] ELSE [] END AS ccontexts FROM r
), b AS (
  SELECT c_custkey AS bundle, jtext, ctext, list_concat(['QUOTED_SPEECH_CONTEXT', 'NEWS_CONTEXT'], coalesce(jcontexts, []), coalesce(ccontexts, [])) AS every
  FROM customer LEFT JOIN j ON jid = c_nationkey AND c_custkey % 9 <> 0 LEFT JOIN c ON cid = c_custkey % 13 AND c_custkey % 8 <> 0
), w AS (
  SELECT bundle, ctext, jtext || chr(10) || 'allowed_contexts: ' || list_reduce(list_filter(every, lambda x, i: list_position(every, x) = i),
    lambda a, x: CASE WHEN length(ltrim(regexp_extract(a, '[^\\n]*$'))) + 2 + length(x) > 60 THEN a || ',' || chr(10) || repeat(' ', 18) || x ELSE a || ', ' || x END) AS jtext FROM b
), h AS (
  SELECT *, '[INSTRUCTION]' || chr(10) || 'Judge only what is given.' || chr(10) || 'Answer as JSON.' || chr(10) || chr(10) || '[GLOBAL_BASELINE]' || chr(10)
    || array_to_string(['taxonomy: 16-category v1', 'severity: 0..5 v1', 'privacy_rules: v1 (immutable)', 'output_schema: guardrail.output.v1', 'thresholds: label_only=0.45 warn=0.62 strong_warn=0.78 critical=0.85', '', '[JURISDICTION_OVERLAY]'], chr(10))
    || coalesce(chr(10) || jtext, '') || chr(10) || chr(10) || '[COMMUNITY_OVERLAY]' || coalesce(chr(10) || ctext, '') || chr(10) AS head FROM w
), m AS (SELECT *, ceil(length(head) / 4)::BIGINT AS tokens FROM h)"""
ORACLES = {
    "manifest_compile": f"""{_WHOLE} SELECT bundle, CASE WHEN tokens <= 1800 THEN md5(head || array_to_string(['', '[INPUT]', '<structured input contract instance>', '', '[OUTPUT]', '<JSON conforming to guardrail.output.v1>', ''], chr(10))) END AS text_md5,
      tokens, CASE WHEN tokens > 1800 THEN 'over_budget' END AS problem FROM m""",
    "manifest_read_back": f"""{_WHOLE} SELECT bundle AS manifest, 'JURISDICTION_OVERLAY' AS section, md5(coalesce(jtext, '')) AS text_md5 FROM m WHERE tokens <= 1800
      UNION ALL SELECT bundle, 'COMMUNITY_OVERLAY', md5(coalesce(ctext, '')) FROM m WHERE tokens <= 1800""",
    "community_counters": """SELECT 'community.' || s_suppkey AS skill_id, place, CASE place WHEN 1 THEN 'c' || s_suppkey ELSE 'other' END AS counter_id, CASE place WHEN 1 THEN s_suppkey % 4 END::INTEGER AS label_at,
      CASE WHEN place = 1 AND s_suppkey % 2 = 0 THEN s_suppkey % 4 + 2 END::INTEGER AS strong_label_at, CASE WHEN place = 2 THEN 9 WHEN s_suppkey % 5 <> 0 THEN s_suppkey % 4 + 5 END::INTEGER AS escalate_at
      FROM supplier, (VALUES (1), (2)) AS t(place) WHERE s_suppkey % 4 <> 0""",
}
