"""Queries of metrics, disparity, calibration, latency, counters, appeals and vectors, with DuckDB SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewell.operators import metrics, ranks, state, vectors
from sievewell.sources.tables import event_times, table
from sievewell.streaming import counters

WEEK = 7 * 86400
THRESHOLDS = {"label_at": 5, "strong_label_at": 20, "escalate_at": 40}


def _pick(key, values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as evaluation cases."""
    k = F.col("doc_id")
    expected = F.when(k % 10 == 0, 1).when(k % 10 == 1, 9).when(k % 10 == 2, 7).when(k % 10 == 3, 5).otherwise(0)
    predicted = F.when(k % 13 == 0, 0).when(k % 17 == 0, 9).otherwise(expected)
    tags = F.filter(F.array(F.when(F.col("lang") != "en", F.lit("Minority_Language")), F.when(k % 7 == 0, F.lit("protected_speech")), F.when(k % 10 == 1, F.lit("pii"))), lambda x: x.isNotNull())
    return table(spark, sf_dir, "documents").select(
        k.alias("case_id"), expected.alias("expected"), predicted.alias("predicted"), (F.col("n_chars") % 997 / 4.0).alias("latency_ms"), tags.alias("tags"), F.col("lang").alias("language"),
        _pick(k, ("religion", "gender", "age", "disability")).alias("protected_class"), (k % 101 / F.lit(100.0)).alias("confidence"), (expected == predicted).alias("correct"),
        F.when(k % 3 != 0, F.col("source")).alias("community"), F.when(k % 2 == 0, F.lit("us")).alias("jurisdiction"))


CASES = """cases AS (
  SELECT *, expected = predicted AS correct FROM (
    SELECT *, CASE WHEN case_id % 13 = 0 THEN 0 WHEN case_id % 17 = 0 THEN 9 ELSE expected END AS predicted FROM (
      SELECT doc_id AS case_id, CASE doc_id % 10 WHEN 0 THEN 1 WHEN 1 THEN 9 WHEN 2 THEN 7 WHEN 3 THEN 5 ELSE 0 END AS expected, n_chars % 997 / 4.0::DOUBLE AS latency_ms,
        list_filter([CASE WHEN lang <> 'en' THEN 'Minority_Language' END, CASE WHEN doc_id % 7 = 0 THEN 'protected_speech' END, CASE WHEN doc_id % 10 = 1 THEN 'pii' END], lambda x: x IS NOT NULL) AS tags,
        lang AS language, ['religion', 'gender', 'age', 'disability'][doc_id % 4 + 1] AS protected_class, doc_id % 101 / 100.0::DOUBLE AS confidence,
        CASE WHEN doc_id % 3 <> 0 THEN source END AS community, CASE WHEN doc_id % 2 = 0 THEN 'us' END AS jurisdiction FROM documents))
)"""


def expectation_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("case_id")
    codes = F.array(F.lit("URL_RISK"), _pick(k, ("LEXICON_HIT", "NEWS_CONTEXT")))
    return cases(spark, sf_dir).select(
        "case_id", "language", "tags", F.col("predicted").alias("category"), (k % 6).cast("int").alias("severity"), codes.alias("codes"), F.when(k % 2 == 0, F.col("expected")).alias("want_category"),
        F.when(k % 5 == 0, 3).alias("want_severity"), F.when(k % 3 == 0, 2).alias("least_severity"), F.when(k % 4 == 0, F.array(F.lit("NEWS_CONTEXT"))).alias("want_codes"), F.when(k % 7 == 0, F.array(F.lit("LEXICON_HIT"))).alias("bar_codes"))


EXPECT = f"""{CASES}, given AS (
  SELECT case_id, language, tags, predicted AS category, case_id % 6 AS severity, ['URL_RISK', ['LEXICON_HIT', 'NEWS_CONTEXT'][case_id % 2 + 1]] AS codes, expected FROM cases
), judged AS (
  SELECT *, list_filter([CASE WHEN case_id % 2 = 0 AND category <> expected THEN 'category' END, CASE WHEN case_id % 5 = 0 AND severity <> 3 THEN 'severity' END,
    CASE WHEN case_id % 3 = 0 AND severity < 2 THEN 'severity_at_least' END, CASE WHEN case_id % 4 = 0 AND NOT list_contains(codes, 'NEWS_CONTEXT') THEN 'codes_missing' END,
    CASE WHEN case_id % 7 = 0 AND list_contains(codes, 'LEXICON_HIT') THEN 'codes_forbidden' END], lambda x: x IS NOT NULL) AS notes FROM given
)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as counter facts."""
    return as_facts(event_times(spark, sf_dir))


def as_facts(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.col("user_id").alias("group_id"), F.col("event_type").alias("counter_id"), "ts", (F.col("event_id") % 5 - 1).alias("delta"))


FACTS = "facts AS (SELECT event_id, user_id AS group_id, event_type AS counter_id, ts, event_id % 5 - 1 AS delta FROM events)"
AS_OF = "2024-01-31 00:00:00"
_now = lambda: F.lit(AS_OF).cast("timestamp")
_ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)


def appeals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_appeals(event_times(spark, sf_dir))


def as_appeals(events: DataFrame) -> DataFrame:
    k = F.col("event_id")
    return events.select(
        (k % 7919).alias("appeal_id"), _pick(k, ("skill_a", "skill_b", "skill_c")).alias("skill_id"), F.when((F.col("user_id") % 3 == 0) & (k % 3 == 0), 1).otherwise(F.col("user_id") % 9 * 2).cast("int").alias("category"),
        (k % 7).cast("int").alias("severity"), F.concat(F.lit("rationale_"), (k % 13).cast("string")).alias("rationale_id"), _pick(F.col("user_id"), ("disagree", "out_of_context", "quoted_speech", "other", "unknown")).alias("user_context"), "ts")


APPEALS = """appeals AS (
  SELECT event_id % 7919 AS appeal_id, ['skill_a', 'skill_b', 'skill_c'][event_id % 3 + 1] AS skill_id, CASE WHEN user_id % 3 = 0 AND event_id % 3 = 0 THEN 1 ELSE user_id % 9 * 2 END::INTEGER AS category,
    (event_id % 7)::INTEGER AS severity, 'rationale_' || event_id % 13 AS rationale_id, ['disagree', 'out_of_context', 'quoted_speech', 'other', 'unknown'][user_id % 5 + 1] AS user_context, ts FROM events
), good AS (
  SELECT * FROM appeals WHERE appeal_id IS NOT NULL AND category BETWEEN 0 AND 15 AND severity BETWEEN 0 AND 5 AND user_context <> 'unknown' AND ts IS NOT NULL
)"""


def _good(spark, d):
    return state.split_appeals(appeals(spark, d))[0]


def _recent(spark, d):
    good = _good(spark, d)
    placed = good.crossJoin(F.broadcast(good.agg(F.max("ts").alias("_now"))))  # one row
    return state.recent(placed, F.col("_now"), 7).groupBy("skill_id", "category").agg(F.count(F.lit(1)).alias("n"))


def _top_all(spark, d):
    good = _good(spark, d)
    parts = [state.top(good, c).withColumnRenamed(c, "value").withColumn("what", F.lit(c)) for c in ("rationale_id", "user_context")]
    return parts[0].unionByName(parts[1])


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="sievewell-")
    here = f"{base.rstrip('/')}/counters-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # as a pattern it may be one file or a folder
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    stream = events.select(F.col("user_id").alias("group_id"), F.col("event_type").alias("counter_id"), "ts", (F.col("event_id") % 5 - 1).alias("delta"))
    counters.run_available(counters.slices(stream), f"{here}/out", f"{here}/state")
    return counters.latest(spark, f"{here}/out").select("group_id", "counter_id", _ntz("start"), "count")


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = ("90", "45s", "30M", "24h", "7D", "-5", "1w", "x", "", "1.5h")
    return table(spark, sf_dir, "nation").select("n_nationkey", _pick(F.col("n_nationkey"), specs).alias("spec")).select("n_nationkey", "spec", state.parse_window(F.col("spec")).alias("seconds"))


def _updates(spark, d):
    return as_updates(table(spark, d, "events"))


def as_updates(events: DataFrame) -> DataFrame:
    k = F.col("event_id")
    return events.select("event_id", F.floor(k / 4).alias("batch_id"), F.col("user_id").alias("group_id"), F.when(k % 17 != 0, F.col("event_type")).alias("counter_id"), (k % 5 - 1).alias("delta"))


def _vectors(spark, d):
    return table(spark, d, "embeddings")


def _scores(spark, d):
    v = _vectors(spark, d)
    return vectors.scores(v, vectors.prototypes(v))


def _head(spark, d):
    """A head whose weights are the prototypes."""
    v = _vectors(spark, d)
    heads = vectors.prototypes(v).select("label", F.col("prototype").alias("weights"), (F.col("label") / 100).alias("bias"))
    return vectors.head_scores(v, heads).select("vec_id", "label_id", *_r("logit", "p"))


_c = lambda f: lambda spark, d: f(cases(spark, d))
_r = lambda *cols: [F.round(c, 6).alias(c) for c in cols]
def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter facts through JSON and back, keys in order."""
    f = facts(spark, sf_dir).select("event_id", F.struct("counter_id", "delta", "group_id").alias("s"))
    return f.select("event_id", F.to_json("s").alias("json"), F.from_json(F.to_json("s"), "counter_id string, delta long, group_id long").alias("b")).select("event_id", "json", "b.group_id", "b.counter_id", "b.delta")


def _latency_by_group(c: DataFrame) -> DataFrame:
    """p95 of each jurisdiction and community, of each jurisdiction, and of all: a case is in three groups."""
    place, own = F.coalesce("jurisdiction", F.lit("global")), F.coalesce("community", F.lit("none"))
    levels = [(place, own, 0), (place, F.lit(None).cast("string"), 1), (F.lit(None).cast("string"), F.lit(None).cast("string"), 2)]
    three = F.array(*[F.struct(p.alias("jurisdiction"), o.alias("community"), F.lit(n).alias("level")) for p, o, n in levels])
    rows = c.select("latency_ms", F.explode(three).alias("g")).select("latency_ms", "g.*")
    got = metrics.latency(rows, "jurisdiction", "community", "level")
    return got.select("jurisdiction", "community", F.round("p95", 6).alias("p95"), "n")


QUERIES = {
    "json_round_trip": _json,
    "metric_recall": _c(lambda c: metrics.recall(c).select("category", *_r("recall"), "n")),
    "metric_precision": _c(lambda c: metrics.precision(c).select("category", *_r("precision"), "n")),
    "metric_fp_rate": _c(lambda c: c.select(F.explode("tags").alias("tag"), "predicted").groupBy(F.lower("tag").alias("tag")).agg(F.round(F.avg((F.col("predicted") != 0).cast("double")), 6).alias("rate"), F.count(F.lit(1)).alias("n"))),
    "metric_report": _c(lambda c: metrics.report(c).select("metric_id", "operator", "threshold", *_r("actual"), "sample_size", "passed")),
    "shipping_gates": _c(lambda c: metrics.report(c).agg(F.bool_and("passed").alias("passed"), F.sum(F.col("passed").cast("long")).alias("n_passed"))),
    "eval_gates": _c(lambda c: metrics.report(c, metrics.EVALUATION).select("metric_id", *_r("actual"), "passed")),
    "latency_p95": _c(lambda c: ranks.percentiles(c, "latency_ms", (0.95,)).select(F.round(F.col("p")[0], 6).alias("p95"))),
    "latency_nearest_rank": _c(lambda c: ranks.percentiles(c, "latency_ms", (0.95,), nearest=True).select(F.col("p")[0].alias("p95"))),
    "latency_report": _c(lambda c: metrics.latency(c, "language").select("language", *_r("p50", "p95", "p99", "mean", "least", "most"), "n")),
    "latency_by_group": _c(_latency_by_group),
    "bias_group_rates": _c(lambda c: metrics.group_rates(c).select("dimension", "value", *_r("rate"), "n")),
    "bias_disparity": _c(lambda c: metrics.disparity(metrics.group_rates(c)).select("dimension", "value", *_r("rate", "excess"), "flagged")),
    "bias_report": _c(lambda c: metrics.disparity(metrics.group_rates(c)).groupBy("dimension").agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("flagged"), F.col("value")))), ",").alias("flagged"), (~F.bool_or("flagged")).alias("passed"))),
    "ece": _c(lambda c: metrics.calibration_error(c).select(*_r("ece"), "n")),
    "eval_cases": lambda s, d: metrics.expectations(expectation_cases(s, d)).select("case_id", F.array_join("notes", ",").alias("notes"), "passed"),
    "eval_by_language": lambda s, d: metrics.expectations(expectation_cases(s, d)).groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("passed").cast("long")).alias("n_passed")),
    "eval_by_tag": lambda s, d: metrics.expectations(expectation_cases(s, d)).select(F.explode("tags").alias("tag"), "passed").groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("passed").cast("long")).alias("n_passed")),
    "detection_rate": _c(lambda c: c.filter("expected <> 0").groupBy("protected_class").agg(F.round(F.avg((F.col("predicted") != 0).cast("double")), 6).alias("rate"), F.count(F.lit(1)).alias("n")).withColumn("passed", F.col("rate") >= F.lit(0.8))),
    "case_results": _c(lambda c: c.select("case_id", "expected", "predicted", "correct")),
    "class_histogram": _c(lambda c: c.groupBy("expected").agg(F.count(F.lit(1)).alias("n"))),
    "per_class_accuracy": _c(lambda c: c.groupBy("expected").agg(F.round(F.avg(F.col("correct").cast("double")), 6).alias("accuracy"))),
    "parse_window": _windows,
    "counter_batches": lambda s, d: state.valid_updates(_updates(s, d)).groupBy("group_id", "counter_id").agg(F.sum("delta").alias("count")),
    "counter_asof": lambda s, d: state.as_of(facts(s, d), _now(), WEEK),
    "counter_trailing": lambda s, d: state.trailing(facts(s, d), WEEK).select("event_id", "count"),
    "counter_label": lambda s, d: state.as_of(facts(s, d), _now(), WEEK).select("group_id", "counter_id", state.label(F.col("count"), THRESHOLDS).alias("label")),
    "counter_expire": lambda s, d: state.expire(facts(s, d), _now(), WEEK).select("event_id", _ntz("ts")),
    "counter_stream": _stream,
    "appeal_recent": _recent,
    "appeal_rates": lambda s, d: state.appeal_rates(_good(s, d)).select("skill_id", "category", "n", *_r("share")),
    "appeal_topk": _top_all,
    "appeal_recommendation": lambda s, d: state.recommendation(state.appeal_rates(_good(s, d))),
    "appeal_dedup": lambda s, d: state.first_of_each(_good(s, d)).select("appeal_id", _ntz("ts"), "rationale_id"),
    "appeal_quarantine": lambda s, d: state.split_appeals(appeals(s, d))[1].select("appeal_id", "category", "severity", "user_context", _ntz("ts")),
    "appeal_skills": lambda s, d: _good(s, d).select("skill_id").distinct(),
    "head_scores": _head,
    "prototype_scores": lambda s, d: _scores(s, d).select("vec_id", "label_id", *_r("cosine")),
    "embedding_verdict": lambda s, d: vectors.verdicts(_vectors(s, d), vectors.prototypes(_vectors(s, d))).select("vec_id", "category", "severity", F.round("confidence", 4).alias("confidence")),
    "embedding_agreement": lambda s, d: vectors.agreement(_vectors(s, d).withColumn("coarse", F.transform("embedding", lambda x: F.round(x.cast("double"), 2))), "embedding", "coarse").select(*_r("least", "mean", "most"), "passed"),
}

_MEAN = "round(avg({}::INTEGER), 6)"
_FP = "predicted <> 0"
_METRICS = {
    "child_safety_recall": ("coalesce(avg(CASE WHEN expected = 1 THEN correct::INTEGER END), 1.0)", "count(*) FILTER (expected = 1)"),
    "child_safety_precision": ("coalesce(avg(CASE WHEN predicted = 1 THEN correct::INTEGER END), 1.0)", "count(*) FILTER (predicted = 1)"),
    "privacy_leak_precision": ("coalesce(avg(CASE WHEN predicted = 9 THEN correct::INTEGER END), 1.0)", "count(*) FILTER (predicted = 9)"),
    "scam_recall": ("coalesce(avg(CASE WHEN expected = 7 THEN correct::INTEGER END), 1.0)", "count(*) FILTER (expected = 7)"),
    "protected_speech_false_positive": ("coalesce(avg(CASE WHEN list_contains(tags, 'protected_speech') THEN (predicted <> 0)::INTEGER END), 0.0)", "count(*) FILTER (list_contains(tags, 'protected_speech'))"),
    "minority_language_false_positive": ("coalesce(avg(CASE WHEN list_contains(tags, 'Minority_Language') THEN (predicted <> 0)::INTEGER END), 0.0)", "count(*) FILTER (list_contains(tags, 'Minority_Language'))"),
    "latency_p95_ms": ("coalesce(quantile_cont(latency_ms, 0.95), 0.0)", "count(*)"),
    "pii_pass_rate": ("coalesce(avg(CASE WHEN list_contains(tags, 'pii') THEN correct::INTEGER END), 1.0)", "count(*) FILTER (list_contains(tags, 'pii'))"),
}


def _report(gates) -> str:
    rows = " UNION ALL ".join(f"SELECT '{g.metric_id}' AS metric_id, '{g.operator}' AS operator, {g.threshold}::DOUBLE AS threshold, {_METRICS[g.metric_id][0]}::DOUBLE AS actual, ({_METRICS[g.metric_id][1]})::BIGINT AS sample_size FROM cases" for g in gates)
    return f"WITH {CASES}, report AS (SELECT *, CASE WHEN operator = '>=' THEN actual >= threshold ELSE actual <= threshold END AS passed FROM ({rows}))"


_RATES = f"""WITH {CASES}, rates AS (
  SELECT 'protected_class' AS dimension, protected_class AS value, avg(({_FP})::INTEGER) AS rate, count(*) AS n FROM cases WHERE expected = 0 GROUP BY protected_class
  UNION ALL SELECT 'language', coalesce(language, ''), avg(({_FP})::INTEGER), count(*) FROM cases WHERE expected = 0 GROUP BY language
), gaps AS (
  SELECT *, rate - avg(rate) OVER (PARTITION BY dimension) AS excess FROM rates
), flagged AS (SELECT *, excess > {metrics.DISPARITY}::DOUBLE OR rate > {metrics.MOST_FALSE_POSITIVES}::DOUBLE AS flagged FROM gaps)"""
_LAT = ", ".join(f"round(quantile_cont(latency_ms, 0.{p}), 6) AS p{p}" for p in (50, 95, 99)) + ", round(avg(latency_ms), 6) AS mean, round(min(latency_ms), 6) AS least, round(max(latency_ms), 6) AS most, count(*) AS n"
_LIVE = f"ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY"
_COUNTS = f"WITH {FACTS}, counts AS (SELECT group_id, counter_id, sum(delta)::BIGINT AS count FROM facts WHERE {_LIVE} GROUP BY ALL)"
_SHARES = f"WITH {APPEALS}, n AS (SELECT skill_id, category, count(*) AS n FROM good GROUP BY ALL), shares AS (SELECT *, n / sum(n) OVER (PARTITION BY skill_id) AS share FROM n)"
_TOP = lambda c: f"SELECT skill_id, value, n, place::INTEGER AS place, '{c}' AS what FROM (SELECT *, row_number() OVER (PARTITION BY skill_id ORDER BY n DESC, first, value) AS place FROM (SELECT skill_id, {c} AS value, count(*) AS n, min(ts) AS first FROM good GROUP BY ALL)) WHERE place <= 5"
_VEC = """WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT label, i, avg(x) AS x FROM x WHERE label IS NOT NULL GROUP BY ALL), p AS (SELECT label, list(x ORDER BY i) AS v FROM m GROUP BY label),
s AS (SELECT vec_id, p.label AS label_id, list_cosine_similarity(embedding::DOUBLE[], v) AS cosine FROM embeddings CROSS JOIN p),
e AS (SELECT *, exp((cosine - max(cosine) OVER (PARTITION BY vec_id)) / 0.01::DOUBLE) AS e FROM s), q AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM e)"""
ORACLES = {
    "json_round_trip": f"""WITH {FACTS} SELECT event_id, '{{"counter_id":"' || counter_id || '","delta":' || delta || ',"group_id":' || group_id || '}}' AS json, group_id, counter_id, delta FROM facts""",
    "metric_recall": f"WITH {CASES} SELECT expected AS category, {_MEAN.format('correct')} AS recall, count(*) AS n FROM cases GROUP BY expected",
    "metric_precision": f"WITH {CASES} SELECT predicted AS category, {_MEAN.format('correct')} AS precision, count(*) AS n FROM cases GROUP BY predicted",
    "metric_fp_rate": f"WITH {CASES} SELECT lower(tag) AS tag, {_MEAN.format(f'({_FP})')} AS rate, count(*) AS n FROM (SELECT unnest(tags) AS tag, predicted FROM cases) GROUP BY 1",
    "metric_report": f"{_report(metrics.SHIPPING)} SELECT metric_id, operator, threshold, round(actual, 6) AS actual, sample_size, passed FROM report",
    "shipping_gates": f"{_report(metrics.SHIPPING)} SELECT bool_and(passed) AS passed, sum(passed::BIGINT)::BIGINT AS n_passed FROM report",
    "eval_gates": f"{_report(metrics.EVALUATION)} SELECT metric_id, round(actual, 6) AS actual, passed FROM report",
    "latency_p95": f"WITH {CASES} SELECT round(quantile_cont(latency_ms, 0.95), 6) AS p95 FROM cases",
    "latency_nearest_rank": f"WITH {CASES} SELECT quantile_disc(latency_ms, 0.95) AS p95 FROM cases",
    "latency_report": f"WITH {CASES} SELECT language, {_LAT} FROM cases GROUP BY language",
    "latency_by_group": f"WITH {CASES}, g AS (SELECT coalesce(jurisdiction, 'global') AS jurisdiction, coalesce(community, 'none') AS community, latency_ms FROM cases) SELECT jurisdiction, community, round(quantile_cont(latency_ms, 0.95), 6) AS p95, count(*) AS n FROM g GROUP BY ROLLUP (jurisdiction, community)",
    "bias_group_rates": f"{_RATES} SELECT dimension, value, round(rate, 6) AS rate, n FROM rates",
    "bias_disparity": f"{_RATES} SELECT dimension, value, round(rate, 6) AS rate, round(excess, 6) AS excess, flagged FROM flagged",
    "bias_report": f"{_RATES} SELECT dimension, coalesce(string_agg(CASE WHEN flagged THEN value END, ',' ORDER BY value), '') AS flagged, NOT bool_or(flagged) AS passed FROM flagged GROUP BY dimension",
    "ece": f"WITH {CASES}, b AS (SELECT len(list_filter([{', '.join(f'{b / 10}::DOUBLE' for b in range(1, 10))}], lambda x: confidence >= x)) AS bin, count(*) AS n, avg(confidence) AS conf, avg(correct::INTEGER) AS acc FROM cases GROUP BY 1) SELECT round(sum(n * abs(conf - acc)) / sum(n), 6) AS ece, sum(n)::BIGINT AS n FROM b",
    "eval_cases": f"WITH {EXPECT} SELECT case_id, array_to_string(notes, ',') AS notes, len(notes) = 0 AS passed FROM judged",
    "eval_by_language": f"WITH {EXPECT} SELECT language, count(*) AS n, sum((len(notes) = 0)::BIGINT)::BIGINT AS n_passed FROM judged GROUP BY language",
    "eval_by_tag": f"WITH {EXPECT} SELECT tag, count(*) AS n, sum((len(notes) = 0)::BIGINT)::BIGINT AS n_passed FROM (SELECT unnest(tags) AS tag, notes FROM judged) GROUP BY tag",
    "detection_rate": f"WITH {CASES} SELECT *, rate >= 0.8::DOUBLE AS passed FROM (SELECT protected_class, {_MEAN.format(f'({_FP})')} AS rate, count(*) AS n FROM cases WHERE expected <> 0 GROUP BY protected_class)",
    "case_results": f"WITH {CASES} SELECT case_id, expected, predicted, correct FROM cases",
    "class_histogram": f"WITH {CASES} SELECT expected, count(*) AS n FROM cases GROUP BY expected",
    "per_class_accuracy": f"WITH {CASES} SELECT expected, {_MEAN.format('correct')} AS accuracy FROM cases GROUP BY expected",
    "parse_window": """SELECT n_nationkey, spec, CASE WHEN regexp_matches(spec, '^\\d+[smhdSMHD]$') THEN TRY_CAST(regexp_extract(spec, '^\\d+') AS BIGINT) * CASE lower(right(spec, 1)) WHEN 'm' THEN 60 WHEN 'h' THEN 3600 WHEN 'd' THEN 86400 ELSE 1 END END AS seconds
      FROM (SELECT n_nationkey, ['90', '45s', '30M', '24h', '7D', '-5', '1w', 'x', '', '1.5h'][n_nationkey % 10 + 1] AS spec FROM nation)""",
    "counter_batches": "WITH u AS (SELECT event_id // 4 AS batch_id, user_id AS group_id, CASE WHEN event_id % 17 <> 0 THEN event_type END AS counter_id, event_id % 5 - 1 AS delta FROM events) SELECT group_id, counter_id, sum(delta)::BIGINT AS count FROM u WHERE batch_id NOT IN (SELECT batch_id FROM u WHERE coalesce(counter_id, '') = '' OR group_id IS NULL OR delta IS NULL) GROUP BY ALL",
    "counter_asof": f"{_COUNTS} SELECT * FROM counts",
    "counter_trailing": f"WITH {FACTS} SELECT event_id, sum(delta) OVER (PARTITION BY group_id, counter_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW)::BIGINT AS count FROM facts",
    "counter_label": f"{_COUNTS} SELECT group_id, counter_id, CASE WHEN count >= 40 THEN 'escalate_at' WHEN count >= 20 THEN 'strong_label_at' WHEN count >= 5 THEN 'label_at' END AS label FROM counts",
    "counter_expire": f"WITH {FACTS} SELECT event_id, ts FROM facts WHERE {_LIVE}",
    "counter_stream": f"WITH {FACTS} SELECT group_id, counter_id, date_trunc('day', ts)::TIMESTAMP AS start, sum(delta)::BIGINT AS count FROM facts GROUP BY ALL",
    "appeal_recent": f"WITH {APPEALS} SELECT skill_id, category, count(*) AS n FROM good WHERE ts >= (SELECT max(ts) FROM good) - INTERVAL 7 DAY GROUP BY ALL",
    "appeal_rates": f"{_SHARES} SELECT skill_id, category, n, round(share, 6) AS share FROM shares",
    "appeal_topk": f"WITH {APPEALS} {_TOP('rationale_id')} UNION ALL {_TOP('user_context')}",
    "appeal_recommendation": f"{_SHARES} SELECT skill_id, ['no_action', 'review_suggested', 'urgent_review'][max(CASE WHEN category = 1 THEN 3 WHEN n >= 5 AND share >= 0.15 THEN 3 WHEN n >= 5 AND share >= 0.05 THEN 2 ELSE 1 END)] AS recommendation FROM shares GROUP BY skill_id",
    "appeal_dedup": f"WITH {APPEALS} SELECT appeal_id, ts, rationale_id FROM good QUALIFY row_number() OVER (PARTITION BY appeal_id ORDER BY ts, rationale_id) = 1",
    "appeal_quarantine": f"WITH {APPEALS} SELECT appeal_id, category, severity, user_context, ts FROM appeals WHERE NOT (category BETWEEN 0 AND 15 AND severity BETWEEN 0 AND 5 AND user_context <> 'unknown')",
    "appeal_skills": f"WITH {APPEALS} SELECT DISTINCT skill_id FROM good",
    "head_scores": f"""{_VEC}, z AS (SELECT s.vec_id, s.label_id, s.cosine * sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE))) + s.label_id / 100.0 AS logit FROM s JOIN embeddings e ON e.vec_id = s.vec_id),
      f AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY vec_id)) AS e FROM z)
      SELECT vec_id, label_id, round(logit, 6) AS logit, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS p FROM f""",
    "prototype_scores": f"{_VEC} SELECT vec_id, label_id, round(cosine, 6) AS cosine FROM s",
    "embedding_verdict": f"""{_VEC}, r AS (SELECT vec_id, label_id, p, lead(p) OVER w AS second, row_number() OVER w AS place FROM q WINDOW w AS (PARTITION BY vec_id ORDER BY p DESC, label_id)),
      f AS (SELECT *, label_id = 0 OR p - coalesce(second, 0) < 0.1::DOUBLE AS safe FROM r WHERE place = 1)
      SELECT vec_id, CASE WHEN safe THEN 0 ELSE label_id END::INTEGER AS category, CASE WHEN safe THEN 0 ELSE 2 END::INTEGER AS severity, round(greatest(0.05, least(0.95, p)), 4) AS confidence FROM f""",
    "embedding_agreement": "SELECT round(min(c), 6) AS least, round(avg(c), 6) AS mean, round(max(c), 6) AS most, min(c) >= 0.94::DOUBLE AS passed FROM (SELECT list_cosine_similarity(embedding::DOUBLE[], list_transform(embedding, lambda x: round(x::DOUBLE, 2))) AS c FROM embeddings)",
}
