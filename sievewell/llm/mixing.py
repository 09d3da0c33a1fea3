"""Mixing sources to target weights by weighted fair queueing.

The documents of a source are shuffled (ordered by a digest of seed and id) and served in
packets of at most `quantum` words, again from the start once all are served, up to
`repeats` times. A packet's virtual finish time is the words its source has sent up to its
end, divided by the source's target. Packets are sorted globally by finish time and cut at
the total budget; at the cut a document may be taken in part.

No step needs all rows of a source in one place. Running sums come in two levels, of
buckets by digest and of rows within a bucket. As virtual time passes evenly, the global
sort deals packets to equal ranges of it and sorts only the range that the budget ends in.

Targets: sources in code-point order, null last, weigh `weights`, repeating, and share
`budget` times all words; none gets more than `repeats` times its size, and what is over
goes to the others by weight, which is one water level over all sources.

Cases: a null or empty text has size 0 and nothing taken; a null source is a source of its
own; a null id is shuffled as an empty one; rows with equal ids are separate documents;
a source without words has target 0; an empty table gives an empty mix. Other columns of
the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievewell.llm.common import n_words, table, written

WEIGHTS = (3, 1, 2)
BUDGET, REPEATS, QUANTUM, CELLS, SEED = 1.5, 2, 256, 16384, "mix-1"
MOST_BROADCAST = 10_000


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """skey, source_size and target of each source; a row for each source."""
    by_source = sizes.groupBy("skey").agg(F.sum("size").alias("source_size"), F.min("source").alias("source"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), (place - 1) % len(weights))
    ranked = by_source.select("skey", "source_size", w.alias("w"), (F.lit(repeats) * F.col("source_size")).alias("cap"), place.alias("place"))
    order = Window.orderBy(F.col("cap") / F.col("w"), "place")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy())
    level = (F.lit(budget) * total - before) / rest
    filled = ranked.withColumn("level", level).withColumn("nth", F.row_number().over(order))
    fits = F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct("nth", "level"))
    return filled.withColumn("at", F.min(fits).over(Window.partitionBy())).select(
        "skey", "source_size",
        F.when(F.col("at").isNull() | (F.col("nth") < F.col("at.nth")), F.col("cap").cast("double")).otherwise(F.col("at.level") * F.col("w")).alias("target"),
    )


def _keyed(docs: DataFrame, seed: str) -> DataFrame:
    skey = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return docs.select("doc_id", "source", "size", skey.alias("skey"), digest.alias("digest"), F.substring(digest, 1, 3).alias("bucket"))


def plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS, quantum: int = QUANTUM, seed: str = SEED) -> DataFrame:
    """For each row of `docs` doc_id, source, size, source_size, target and taken, the words that the mix takes of it."""
    keyed = _keyed(written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "mix-sizes"), seed)
    by_source = targets(keyed, weights, budget, repeats)
    to_bucket = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = keyed.groupBy("skey", "bucket").agg(F.sum("size").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(to_bucket), F.lit(0)))
    offsets = buckets.join(by_source, "skey").select("skey", "bucket", "base", "source_size", "target")
    in_bucket = Window.partitionBy("skey", "bucket").orderBy("digest", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = keyed.join(offsets, ["skey", "bucket"]).withColumn("begin", F.col("base") + F.sum("size").over(in_bucket) - F.col("size"))
    placed = written(placed.select("doc_id", "source", "size", "skey", "source_size", "target", "begin"), "mix-placed")

    n = F.ceil(F.col("size") / quantum)
    sent = placed.filter((F.col("size") > 0) & (F.col("target") > 0)).select(
        "skey", "target", "size", "begin", "source_size", F.explode(F.sequence(F.lit(0), (n * repeats - 1).cast("int"))).alias("i"), n.alias("n"))
    k = F.col("i") % F.col("n")
    end = F.least((k + 1) * quantum, F.col("size"))
    at = F.floor(F.col("i") / F.col("n")) * F.col("source_size") + F.col("begin") + end
    packets = sent.select("skey", (end - k * quantum).cast("long").alias("words"), at.cast("long").alias("at"), (at / F.col("target")).alias("finish"))
    packets = packets.withColumn("cell", F.floor(F.col("finish") * CELLS))

    cells = packets.groupBy("cell").agg(F.sum("words").alias("n"))
    upto = F.sum("n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
    goal = keyed.agg(F.floor(F.lit(budget) * F.sum("size")).cast("long").alias("goal"))
    reached = cells.withColumn("upto", upto).crossJoin(F.broadcast(goal)).filter(F.col("upto") >= F.col("goal"))
    last = reached.agg(F.min(F.struct("cell", (F.col("goal") - F.col("upto") + F.col("n")).alias("rest"))).alias("last"))  # one row
    near = packets.crossJoin(F.broadcast(last)).filter(F.col("last.cell").isNull() | (F.col("cell") <= F.col("last.cell")))
    whole = near.filter(F.col("last.cell").isNull() | (F.col("cell") < F.col("last.cell"))).select("skey", "words")
    in_last = Window.partitionBy("cell").orderBy("finish", "skey", "at").rowsBetween(Window.unboundedPreceding, 0)
    cut = near.filter(F.col("cell") == F.col("last.cell")).withColumn("upto", F.sum("words").over(in_last))
    part = cut.select("skey", F.least("words", F.greatest(F.col("last.rest") - F.col("upto") + F.col("words"), F.lit(0))).alias("words"))
    served = whole.unionByName(part).groupBy("skey").agg(F.sum("words").alias("served"))

    if by_source.count() <= MOST_BROADCAST:  # a row for each source; without it, the join's own skew handling splits a hot source
        served = F.broadcast(served)
    taken = F.lit(0).cast("long")
    for e in range(repeats):
        left = F.coalesce(F.col("served"), F.lit(0)) - e * F.col("source_size") - F.col("begin")
        taken = taken + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return placed.join(served, "skey", "left").select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def query(spark, sf_dir: str) -> DataFrame:
    return plan(table(spark, sf_dir, "documents")).drop("source")


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce('s' || source, '') AS skey, md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS digest,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT skey, sum(size)::BIGINT AS source_size, min(source) AS source FROM d GROUP BY skey
), r AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s
), w AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(place - 1) % 3 + 1] AS w, {REPEATS} * source_size AS cap FROM r
), l AS (
  SELECT *, row_number() OVER o AS nth,
    ({BUDGET}::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW o AS (ORDER BY cap / w, place)
), a AS (
  SELECT min(nth) AS nth, arg_min(level, nth) AS level FROM l WHERE level <= cap / w
), t AS (
  SELECT skey, source_size, CASE WHEN a.nth IS NULL OR l.nth < a.nth THEN cap::DOUBLE ELSE a.level * w END AS target FROM l CROSS JOIN a
), p AS (
  SELECT row_number() OVER () AS rid, d.*, source_size, target,
    (sum(size) OVER (PARTITION BY skey ORDER BY digest, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS begin
  FROM d JOIN t USING (skey)
), k AS (
  SELECT skey, rid, target, least({QUANTUM}, size - i * {QUANTUM})::BIGINT AS words, (e * source_size + begin + least((i + 1) * {QUANTUM}, size))::BIGINT AS pos
  FROM (SELECT *, unnest(range(0, (size + {QUANTUM} - 1) // {QUANTUM})) AS i FROM p WHERE size > 0 AND target > 0) CROSS JOIN (SELECT unnest(range({REPEATS})) AS e)
), q AS (
  SELECT skey, words, sum(words) OVER (ORDER BY pos / target, skey, pos ROWS UNBOUNDED PRECEDING) AS upto FROM k
), v AS (
  SELECT skey, sum(least(words, greatest(goal - upto + words, 0)))::BIGINT AS served
  FROM q CROSS JOIN (SELECT floor({BUDGET}::DOUBLE * sum(size))::BIGINT AS goal FROM d) GROUP BY skey
)
SELECT doc_id, size, source_size, target,
  ({" + ".join(f"greatest(0, least(size, coalesce(served, 0) - {e} * source_size - begin))" for e in range(REPEATS))})::BIGINT AS taken
FROM p LEFT JOIN v USING (skey)"""
