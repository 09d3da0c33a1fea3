"""Counters that expire, and appeals: trailing windows over facts of (group, counter, time, delta)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LABELS = ("escalate_at", "strong_label_at", "label_at")
URGENT, REVIEW, LEAST_APPEALS = 0.15, 0.05, 5
USER_CONTEXTS = ("disagree", "out_of_context", "quoted_speech", "other")


def parse_window(spec: Column) -> Column:
    """Seconds of a window such as 45s, 30m, 24h or 7d; null for anything else, a number without a unit or beyond a long too."""
    unit = F.lower(F.right(spec, F.lit(1)))
    n = F.regexp_extract(spec, r"^(\d+)[smhdSMHD]$", 1).try_cast("long")
    return F.try_multiply(n, F.when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400).otherwise(1))


def valid_updates(updates: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Updates of batches in which every update has a group and a counter, neither empty, and a delta; a bad one rejects its batch."""
    lacks = lambda c: F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) == 0
    rejected = updates.filter(lacks("group_id") | lacks("counter_id") | F.col("delta").isNull()).select(batch).distinct()
    return updates.join(rejected, batch, "left_anti")


def as_of(facts: DataFrame, now: Column, seconds: int) -> DataFrame:
    """Counts at `now`: all deltas not older than the window, those after `now` too."""
    live = facts.filter(F.unix_micros("ts") >= F.unix_micros(now) - seconds * 1_000_000)
    return live.groupBy("group_id", "counter_id").agg(F.sum("delta").alias("count"))


def trailing(facts: DataFrame, seconds: int) -> DataFrame:
    """Each fact with the count of its key over the window that ends with it.

    A fact goes to the time bucket it is in and to the next one, and windows are sorted
    within a key's bucket: no task holds more of a key than two windows.
    """
    width = seconds * 1_000_000
    placed = facts.withColumn("_t", F.unix_micros("ts")).withColumn("_own", F.floor(F.col("_t") / width))
    both = placed.withColumn("_bucket", F.explode(F.array("_own", F.col("_own") + 1)))
    frame = Window.partitionBy("group_id", "counter_id", "_bucket").orderBy("_t").rangeBetween(-width, 0)
    counted = both.withColumn("count", F.sum("delta").over(frame))
    return counted.filter("_bucket = _own").drop("_t", "_own", "_bucket")


def label(count: Column, thresholds: Mapping[str, int]) -> Column:
    """The first threshold met, from the highest; null if none is."""
    out = F.lit(None).cast("string")
    for name in reversed(LABELS):
        if name in thresholds:
            out = F.when(count >= thresholds[name], F.lit(name)).otherwise(out)
    return out


def expire(facts: DataFrame, now: Column, seconds: int) -> DataFrame:
    return facts.filter(F.unix_micros("ts") >= F.unix_micros(now) - seconds * 1_000_000)


def split_appeals(appeals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Appeals that are well formed, and those for quarantine."""
    good = F.col("appeal_id").isNotNull() & F.col("category").between(0, 15) & F.col("severity").between(0, 5) & F.col("user_context").isin(*USER_CONTEXTS) & F.col("ts").isNotNull()
    good = F.coalesce(good, F.lit(False))
    return appeals.filter(good), appeals.filter(~good)


def recent(appeals: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Appeals of the last `days` days before `now`, the bound included, and later ones. Without a time none is."""
    if days < 1:
        raise ValueError("a window has one day or more")
    return appeals.filter(F.unix_micros(F.col("ts").cast("timestamp")) >= F.unix_micros(now.cast("timestamp")) - days * 86_400_000_000)


def first_of_each(appeals: DataFrame) -> DataFrame:
    """The earliest appeal of each id; later ones are rejected."""
    order = Window.partitionBy("appeal_id").orderBy("ts", "rationale_id")
    return appeals.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def appeal_rates(appeals: DataFrame) -> DataFrame:
    """Appeals of each skill and category, and their share of the skill's appeals."""
    counts = appeals.groupBy("skill_id", "category").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("skill_id")))


def top(appeals: DataFrame, column: str, k: int = 5) -> DataFrame:
    """The k most frequent values of a column by skill; of equals the first seen, then by value."""
    counts = appeals.groupBy("skill_id", column).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"))
    order = Window.partitionBy("skill_id").orderBy(F.desc("n"), "first", column)
    return counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).drop("first")


def recommendation(rates: DataFrame) -> DataFrame:
    """What to do about each skill: any child-safety appeal is urgent; else by share, of categories with enough appeals."""
    enough = F.col("n") >= LEAST_APPEALS
    rank = F.when(F.col("category") == 1, 2).when(enough & (F.col("share") >= F.lit(URGENT)), 2).when(enough & (F.col("share") >= F.lit(REVIEW)), 1).otherwise(0)
    name = F.element_at(F.array(F.lit("no_action"), F.lit("review_suggested"), F.lit("urgent_review")), F.max(rank) + 1)
    return rates.groupBy("skill_id").agg(name.alias("recommendation"))
