"""As-of join: each row with the latest entry of its key that isn't after it, without a range join.

Both sides are cut into buckets of time and sorted together within a key's bucket, where the
last entry is carried forward; what earlier buckets leave is carried over a table of one row
for each key and bucket. So no task holds more of a key than a bucket, however many rows the
key has; the table of buckets is as long as the time spanned, not as the input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def as_of(rows: DataFrame, entries: DataFrame, keys: Sequence[str], at: str, values: Sequence[str], seconds: int = 86400) -> DataFrame:
    """`rows` with the `values` of the entry of the same keys that is latest at `at`; entries at the same time count as not after.

    Of entries at the same time the one with the greatest values, compared in their order, is taken. Null keys are a key.
    Rows without an entry before them, or without a time, get nulls; entries without a time are left out.
    """
    micros = F.unix_micros(F.col(at))
    bucket = F.floor(micros / F.lit(seconds * 1_000_000))
    kinds = {f.name: f.dataType for f in entries.schema}
    left = rows.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], bucket.alias("_bucket"), micros.alias("_t"), F.struct(*[rows[f"`{c}`"] for c in rows.columns]).alias("_row"))
    held = F.struct(micros.alias("t"), *[F.col(v) for v in values])
    right = entries.filter(F.col(at).isNotNull()).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], bucket.alias("_bucket"), micros.alias("_t"), held.alias("_v"))
    by = [f"_k{i}" for i in range(len(keys))]

    lasts = right.groupBy(*by, "_bucket").agg(F.max("_v").alias("_last"))
    wanted = left.select(*by, "_bucket").distinct().withColumn("_last", F.lit(None).cast(lasts.schema["_last"].dataType))
    steps = lasts.unionByName(wanted).groupBy(*by, "_bucket").agg(F.max("_last").alias("_last"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = steps.select(*[F.col(b).alias(f"{b}c") for b in by], F.col("_bucket").alias("_bucketc"), F.last("_last", ignorenulls=True).over(before).alias("_carry")).filter("_carry IS NOT NULL")

    both = left.withColumn("_v", F.lit(None).cast(right.schema["_v"].dataType)).unionByName(right.withColumn("_row", F.lit(None).cast(left.schema["_row"].dataType)))
    here = Window.partitionBy(*by, "_bucket").orderBy("_t", F.col("_row").isNotNull(), "_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = both.withColumn("_own", F.last("_v", ignorenulls=True).over(here)).filter("_row IS NOT NULL")
    same = F.col("_bucket").eqNullSafe(F.col("_bucketc"))
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"{b}c"))
    found = F.when(F.col("_t").isNotNull(), F.coalesce("_own", "_carry"))
    joined = placed.join(carried, same, "left").select("_row", found.alias("_found"))
    return joined.select("_row.*", *[F.col("_found")[v].cast(kinds[v]).alias(v) for v in values])
