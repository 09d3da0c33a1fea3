"""Exact percentiles without sorting: rank selection by narrowing ranges of values.

For each wanted rank of each group a round counts the group's values in `bins` equal ranges
between the least and the most that the rank can still be, and keeps the range that holds it.
The rank is found when all values of its range are equal. A round is one pass over the data
and one shuffle of counts, at most `bins` rows for each task and rank, whatever the number of
rows, and so no task sorts or gathers a group. Ranges shrink `bins`-fold a round: two to four
rounds for values of even spread, more if a few lie far out.

Groups beyond MOST_GROUPS, of which an average one is small, take Spark's own percentiles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BINS, MOST_GROUPS = 1024, 2000


def at_ranks(df: DataFrame, column: str, targets: DataFrame, keys: Sequence[str], bins: int = BINS) -> DataFrame:
    """keys, rank and value for each of `targets` (keys, rank from 0 on, lo, hi), which are few enough for a broadcast."""
    spark = df.sparkSession
    values = df.select(*keys, F.col(column).cast("double").alias("_x")).filter("_x IS NOT NULL")
    of = targets.select(*keys, "rank", F.col("rank").alias("left"), "lo", "hi")
    schema, done = of.schema, []
    todo = of.collect()
    while todo:
        done += [r for r in todo if r["lo"] == r["hi"]]
        open_ = [r for r in todo if r["lo"] != r["hi"]]
        if not open_:
            break
        now = F.broadcast(spark.createDataFrame(open_, schema).toDF(*[f"_{c}" for c in schema.names]))
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        inside = values.join(now, same & F.col("_x").between(F.col("_lo"), F.col("_hi")))
        at = F.least(F.floor((F.col("_x") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * bins), F.lit(bins - 1))
        named = [F.col(f"_{k}").alias(k) for k in keys]
        counted = inside.groupBy(*named, F.col("_rank").alias("rank"), F.col("_left").alias("left"), at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
        before = F.sum("n").over(Window.partitionBy(*keys, "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
        found = counted.withColumn("before", F.coalesce(before, F.lit(0))).filter((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("n")))
        todo = found.select(*keys, "rank", (F.col("left") - F.col("before")).alias("left"), "lo", "hi").collect()  # a row for each rank wanted
    return spark.createDataFrame(done, schema).select(*keys, "rank", F.col("lo").alias("value"))


def percentiles(df: DataFrame, column: str, shares: Sequence[float], keys: Sequence[str] = (), nearest: bool = False, bins: int = BINS) -> DataFrame:
    """keys and p, an array of the exact percentiles of `shares`: linear between ranks, or the nearest rank at or above.

    Null values count for nothing; a group without others has null percentiles. Nulls in keys are a key."""
    spark = df.sparkSession
    x = F.col(column).cast("double")
    groups = df.groupBy(*keys).agg(F.count(x).alias("_n"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    first = groups.limit(MOST_GROUPS + 1).collect()
    if len(first) > MOST_GROUPS:
        own = [F.expr(f"percentile_disc({s}) WITHIN GROUP (ORDER BY CAST(`{column}` AS DOUBLE))") if nearest else F.percentile(x, F.lit(s)) for s in shares]
        return df.groupBy(*keys).agg(F.array(*own).alias("p"))
    places = spark.createDataFrame(first, groups.schema)

    def place(s: float):
        """(rank below, rank above, weight of the one above)."""
        at = (F.col("_n") - 1) * F.lit(float(s))
        if nearest:
            one = F.greatest(F.ceil(F.col("_n") * F.lit(float(s))) - 1, F.lit(0))
            return one, one, F.lit(0.0)
        return F.floor(at), F.ceil(at), at - F.floor(at)

    ranks = F.array(*[r.cast("long") for s in shares for r in place(s)[:2]])
    targets = places.filter("_n > 0").select(*keys, F.explode(F.array_distinct(ranks)).alias("rank"), "lo", "hi")
    got = at_ranks(df, column, targets, keys, bins)
    by_rank = got.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_at"))  # as many as ranks wanted
    if keys:
        renamed = by_rank.toDF(*[f"_{k}" for k in keys], "_at")
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        joined = places.join(F.broadcast(renamed), same, "left")
    else:
        joined = places.join(F.broadcast(by_rank), F.lit(True), "left")
    out = []
    for s in shares:
        below, above, weight = place(s)
        low, high = (F.col("_at")[r.cast("long")] for r in (below, above))
        out.append(F.when(F.col("_n") > 0, low + (high - low) * weight if not nearest else low))
    return joined.select(*keys, F.array(*out).alias("p"))
