"""Verdicts of the screening held against labels: a message is expected to be flagged if its document is labelled toxic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewell.operators import metrics
from sievewell.plans import screen
from sievewell.sources import openpacks
from sievewell.sources.tables import messages, table


def judged(verdicts: DataFrame, labels: DataFrame) -> DataFrame:
    """Cases from verdicts (msg_id, lang, verdict) and labels (doc_id, toxic): what was expected, what was predicted, and how sure. Rows without a label are none."""
    known = labels.filter(F.col("toxic").isNotNull()).select(F.col("doc_id").alias("msg_id"), F.col("toxic").cast("int").alias("expected"))
    predicted = (F.col("verdict.category") != 0).cast("int")
    rows = verdicts.join(known, "msg_id")
    return rows.select(
        F.col("msg_id").alias("case_id"), F.col("lang").alias("language"), "expected", predicted.alias("predicted"), F.col("verdict.confidence").alias("confidence"), (F.col("expected") == predicted).alias("correct"))


def held_to(expected: DataFrame) -> DataFrame:
    """case_id, language, passed and notes of rows with what a case expects (see `openpacks.CASE`) and its `verdict`.

    What a case does not state is not held against it; the notes name each expectation that fails, in the order of the columns.
    """
    v, none = F.col("verdict"), F.array().cast("array<string>")
    codes = F.coalesce(v["reason_codes"], none)
    fails = {
        "category": v["category"] != F.col("expected_category"),
        "severity": v["severity"] != F.col("expected_severity"),
        "severity_at_least": v["severity"] < F.col("severity_at_least"),
        "must_include": F.size(F.array_except(F.coalesce("must_include", none), codes)) > 0,
        "must_exclude": F.size(F.array_intersect(F.coalesce("must_exclude", none), codes)) > 0,
    }
    notes = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in fails.items()]))
    return expected.select("case_id", "language", (F.size(notes) == 0).alias("passed"), F.array_join(notes, ",").alias("notes"))


def case_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case for evaluation as JSON for each message, with an expectation of one kind or another; some without an id or cut off."""
    m = messages(spark, sf_dir)
    k = F.col("msg_id")
    words = lambda on: F.when(on, F.array(F.lit("LEXICON_HIT")))
    expected = F.struct(
        F.when(k % 5 == 0, 7).when(k % 5 == 4, 0).alias("category"), F.when(k % 3 == 0, 3).alias("severity"), F.when(k % 5 == 1, 3).alias("severity_at_least"), words(k % 5 == 2).alias("reason_codes_must_include"), words(k % 5 == 3).alias("reason_codes_must_exclude"))
    case = F.to_json(F.struct(
        F.when(k % 23 != 0, F.concat(F.lit("c"), k.cast("string"))).alias("case_id"), F.col("lang").alias("language"),
        F.struct("text", F.when(F.col("quoted"), F.lit(True)).alias("quoted_from_user")).alias("message"), F.struct(F.col("overlay").alias("community_overlay_id")).alias("context"), expected.alias("expected")))
    return m.select(F.when(k % 29 == 0, F.substring(case, F.lit(1), F.length(case) - 1)).otherwise(case).alias("given"))


def _eval_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases are opened, screened as any message, and held to what they expect."""
    opened, _ = openpacks.parted(openpacks.case_rows(case_texts(spark, sf_dir), "given"))
    rows = opened.withColumns({"msg_id": F.col("case_id"), "lang": F.col("language_hint"), "group_id": F.lit(None).cast("string"), "nsfw": F.lit(None).cast("double")})
    return held_to(screen.screened(rows))


def _quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bad = openpacks.parted(openpacks.case_rows(case_texts(spark, sf_dir), "given"))
    return bad.groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(screen.screen(messages(spark, sf_dir)), table(spark, sf_dir, "labels"))


def _by_language(c: DataFrame) -> DataFrame:
    """False positives and misses of each language, as shares of what was expected to be safe or not."""
    wrong = F.col("predicted") != F.col("expected")
    rate = lambda e: F.round(F.avg(F.when(F.col("expected") == e, wrong.cast("double"))), 6)
    return c.groupBy("language").agg(rate(0).alias("false_positive"), rate(1).alias("missed"), F.count(F.lit(1)).alias("n"))


QUERIES = {
    "judged_recall": lambda s, d: metrics.recall(_cases(s, d)).select("category", F.round("recall", 6).alias("recall"), "n"),
    "judged_precision": lambda s, d: metrics.precision(_cases(s, d)).select("category", F.round("precision", 6).alias("precision"), "n"),
    "judged_by_language": lambda s, d: _by_language(_cases(s, d)),
    "eval_cases": _eval_cases,
    "eval_quarantine": _quarantined,
    "judged_calibration": lambda s, d: metrics.calibration_error(_cases(s, d)).select(F.round("ece", 6).alias("ece"), "n"),
}

_CASES = f"""WITH v AS ({screen.ORACLES['policy_verdict']}), cases AS (
  SELECT v.msg_id AS case_id, d.lang AS language, toxic::INTEGER AS expected, (category <> 0)::INTEGER AS predicted, confidence, toxic::INTEGER = (category <> 0)::INTEGER AS correct
  FROM v JOIN documents d ON d.doc_id = v.msg_id JOIN labels l ON l.doc_id = v.msg_id WHERE toxic IS NOT NULL
)"""
ORACLES = {
    "judged_recall": f"{_CASES} SELECT expected AS category, round(avg(correct::INTEGER), 6) AS recall, count(*) AS n FROM cases GROUP BY expected",
    "judged_precision": f"{_CASES} SELECT predicted AS category, round(avg(correct::INTEGER), 6) AS precision, count(*) AS n FROM cases GROUP BY predicted",
    "judged_by_language": f"{_CASES} SELECT language, round(avg((NOT correct)::INTEGER) FILTER (expected = 0), 6) AS false_positive, round(avg((NOT correct)::INTEGER) FILTER (expected = 1), 6) AS missed, count(*) AS n FROM cases GROUP BY language",
    "judged_calibration": f"{_CASES}, b AS (SELECT len(list_filter([{', '.join(f'{b / 10}::DOUBLE' for b in range(1, 10))}], lambda x: confidence >= x)) AS bin, count(*) AS n, avg(confidence) AS conf, avg(correct::INTEGER) AS acc FROM cases GROUP BY 1) SELECT round(sum(n * abs(conf - acc)) / sum(n), 6) AS ece, sum(n)::BIGINT AS n FROM b",
    "eval_cases": f"""{screen.POLICY_WITHOUT_MEDIA}, held AS (
      SELECT msg_id, lang, list_filter([CASE WHEN msg_id % 5 = 0 AND category <> 7 OR msg_id % 5 = 4 AND category <> 0 THEN 'category' END, CASE WHEN msg_id % 3 = 0 AND severity <> 3 THEN 'severity' END, CASE WHEN msg_id % 5 = 1 AND severity < 3 THEN 'severity_at_least' END,
        CASE WHEN msg_id % 5 = 2 AND NOT list_contains(codes, 'LEXICON_HIT') THEN 'must_include' END, CASE WHEN msg_id % 5 = 3 AND list_contains(codes, 'LEXICON_HIT') THEN 'must_exclude' END], lambda x: x IS NOT NULL) AS notes
      FROM policy WHERE msg_id % 23 <> 0 AND msg_id % 29 <> 0
    ) SELECT 'c' || msg_id AS case_id, coalesce(lang, 'und') AS language, len(notes) = 0 AS passed, array_to_string(notes, ',') AS notes FROM held""",
    "eval_quarantine": "SELECT CASE WHEN doc_id % 29 = 0 THEN 'not_json' ELSE 'missing_case_id' END AS problem, count(*) AS n FROM documents WHERE doc_id % 29 = 0 OR doc_id % 23 = 0 GROUP BY 1",
}
