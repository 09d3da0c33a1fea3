"""Quality, calibration, group-disparity and latency figures over cases of expected and predicted categories."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievewell.operators.ranks import percentiles


@dataclass(frozen=True)
class Gate:
    metric_id: str
    operator: str
    threshold: float


# What a release must reach, and what a held-out evaluation must.
SHIPPING = (Gate("child_safety_recall", ">=", 0.98), Gate("child_safety_precision", ">=", 0.90), Gate("privacy_leak_precision", ">=", 0.90), Gate("scam_recall", ">=", 0.85), Gate("protected_speech_false_positive", "<=", 0.05), Gate("minority_language_false_positive", "<=", 0.07), Gate("latency_p95_ms", "<=", 250.0))
EVALUATION = (Gate("child_safety_recall", ">=", 0.95), Gate("pii_pass_rate", ">=", 0.85), Gate("protected_speech_false_positive", "<=", 0.05), Gate("minority_language_false_positive", "<=", 0.10))
DISPARITY, MOST_FALSE_POSITIVES = 0.05, 0.07


def share(hit: Column, of: Column, empty: float) -> Column:
    """The share of `hit` among rows where `of` holds; `empty` if there is none."""
    return F.coalesce(F.avg(F.when(of, hit.cast("double"))), F.lit(empty))


def number(of: Column) -> Column:
    return F.sum(F.when(of, 1).otherwise(0)).cast("long")


def tagged(tag: str) -> Column:
    return F.exists("tags", lambda t: F.lower(t) == tag.lower())


def recall(cases: DataFrame) -> DataFrame:
    hit = (F.col("predicted") == F.col("expected")).cast("double")
    return cases.groupBy(F.col("expected").alias("category")).agg(F.avg(hit).alias("recall"), F.count(F.lit(1)).alias("n"))


def precision(cases: DataFrame) -> DataFrame:
    hit = (F.col("predicted") == F.col("expected")).cast("double")
    return cases.groupBy(F.col("predicted").alias("category")).agg(F.avg(hit).alias("precision"), F.count(F.lit(1)).alias("n"))


def report(cases: DataFrame, gates=SHIPPING) -> DataFrame:
    """A row for each of the seven metrics: actual, threshold, passed and sample size. One pass over the cases, besides those of rank selection."""
    if any(g.metric_id == "latency_p95_ms" for g in gates):
        cases = cases.withColumn("_p95", F.lit(percentiles(cases, "latency_ms", (0.95,)).first()["p"][0]).cast("double"))
    e, p = F.col("expected"), F.col("predicted")
    same, wrong, any_row = e == p, p != 0, F.lit(True)
    measures = {
        "child_safety_recall": (share(same, e == 1, 1.0), number(e == 1)), "child_safety_precision": (share(same, p == 1, 1.0), number(p == 1)),
        "privacy_leak_precision": (share(same, p == 9, 1.0), number(p == 9)), "scam_recall": (share(same, e == 7, 1.0), number(e == 7)),
        "protected_speech_false_positive": (share(wrong, tagged("protected_speech"), 0.0), number(tagged("protected_speech"))),
        "minority_language_false_positive": (share(wrong, tagged("minority_language"), 0.0), number(tagged("minority_language"))),
        "latency_p95_ms": (F.coalesce(F.any_value("_p95"), F.lit(0.0)), number(any_row)),
        "pii_pass_rate": (share(same, tagged("pii"), 1.0), number(tagged("pii"))),
    }
    one = cases.agg(*[F.struct(measures[g.metric_id][0].alias("actual"), measures[g.metric_id][1].alias("n")).alias(g.metric_id) for g in gates])
    rows = F.array(*[F.struct(F.lit(g.metric_id).alias("metric_id"), F.lit(g.operator).alias("operator"), F.lit(g.threshold).alias("threshold"), F.col(f"{g.metric_id}.actual").alias("actual"), F.col(f"{g.metric_id}.n").alias("sample_size")) for g in gates])
    flat = one.select(F.explode(rows).alias("r")).select("r.*")
    return flat.withColumn("passed", F.when(F.col("operator") == ">=", F.col("actual") >= F.col("threshold")).otherwise(F.col("actual") <= F.col("threshold")))


def group_rates(cases: DataFrame) -> DataFrame:
    """False-positive rate of each protected class and of each language, over rows expected to be safe."""
    safe = cases.filter("expected = 0").select("protected_class", "language", (F.col("predicted") != 0).cast("double").alias("fp"))
    sets = safe.groupingSets([[F.col("protected_class")], [F.col("language")]], F.col("protected_class"), F.col("language"))
    got = sets.agg(F.grouping("language").alias("by_class"), F.avg("fp").alias("rate"), F.count(F.lit(1)).alias("n"))
    return got.select(F.when(F.col("by_class") == 1, F.lit("protected_class")).otherwise(F.lit("language")).alias("dimension"), F.coalesce(F.when(F.col("by_class") == 1, F.col("protected_class")).otherwise(F.col("language")), F.lit("")).alias("value"), "rate", "n")


def disparity(rates: DataFrame) -> DataFrame:
    """Rates with the excess over the unweighted mean of their dimension, and whether they are flagged."""
    mean = F.avg("rate").over(Window.partitionBy("dimension"))
    out = rates.withColumn("excess", F.col("rate") - mean)
    return out.withColumn("flagged", (F.col("excess") > F.lit(DISPARITY)) | (F.col("rate") > F.lit(MOST_FALSE_POSITIVES)))


def calibration_error(cases: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error of `confidence` against `correct`; bins closed below, the last also above."""
    conf = F.col("confidence")
    at = F.aggregate(F.array(*[F.lit(b / bins) for b in range(1, bins)]), F.lit(0), lambda n, edge: n + (conf >= edge).cast("int"))
    by_bin = cases.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("conf"), F.avg(F.col("correct").cast("double")).alias("acc"))
    return by_bin.agg(F.coalesce(F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n"), F.lit(0.0)).alias("ece"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def expectations(cases: DataFrame) -> DataFrame:
    """Each case with what it fails of its expectations: category, severity, least severity, codes that must be in or out."""
    checks = {
        "category": F.col("want_category").isNull() | (F.col("category") == F.col("want_category")),
        "severity": F.col("want_severity").isNull() | (F.col("severity") == F.col("want_severity")),
        "severity_at_least": F.col("least_severity").isNull() | (F.col("severity") >= F.col("least_severity")),
        "codes_missing": F.col("want_codes").isNull() | (F.size(F.array_except("want_codes", "codes")) == 0),
        "codes_forbidden": F.col("bar_codes").isNull() | ~F.arrays_overlap("bar_codes", "codes"),
    }
    notes = F.filter(F.array(*[F.when(~ok, F.lit(k)) for k, ok in checks.items()]), lambda x: x.isNotNull())
    return cases.withColumn("notes", notes).withColumn("passed", F.size("notes") == 0)


def latency(obs: DataFrame, *keys: str) -> DataFrame:
    """p50, p95 and p99 (linear), mean, least and most of latency_ms by keys."""
    x = "latency_ms"
    rest = obs.groupBy(*keys).agg(F.avg(x).alias("mean"), F.min(x).alias("least"), F.max(x).alias("most"), F.count(F.lit(1)).alias("n"))
    at = percentiles(obs, x, (0.5, 0.95, 0.99), keys).toDF(*[f"_{k}" for k in keys], "_p")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rest.join(at, same).select(*keys, *[F.col("_p")[i].alias(f"p{p}") for i, p in enumerate((50, 95, 99))], "mean", "least", "most", "n")
