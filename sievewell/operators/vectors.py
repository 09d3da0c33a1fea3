"""Prototype scores of embeddings, and verdicts from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEMPERATURE, MARGIN = 0.01, 0.10
MOST_PROTOTYPES = 10_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def prototypes(vectors: DataFrame) -> DataFrame:
    """The mean vector of each label, of length one."""
    parts = vectors.filter("label IS NOT NULL").select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    whole = means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("v"))
    return whole.select("label", F.transform("v", lambda x: x / norm(F.col("v"))).alias("prototype"))


def _let(value: Column, body) -> Column:
    """`body(value)` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _scored(vectors: DataFrame, heads: DataFrame, cosine: bool = False, temperature: float = 1.0) -> DataFrame:
    """vec_id and _s, an array of (label_id, logit, p) in label order. All heads are one row of a checked number of labels, and softmax is within a vector's row: nothing is shuffled."""
    if (n := heads.count()) > MOST_PROTOTYPES:
        raise ValueError(f"{n} labels; {MOST_PROTOTYPES} are broadcast at most")
    packed = heads.agg(F.sort_array(F.collect_list(F.struct("label", "weights", "bias"))).alias("_head"))
    x = F.col("embedding")

    def logits(size: Column) -> Column:
        return F.transform("_head", lambda h: F.struct(h["label"].alias("label_id"), (dot(x, h["weights"]) / size + h["bias"]).alias("logit")))

    def shifted(of: Column) -> Column:
        return _let(F.array_max(F.transform(of, lambda s: s["logit"])), lambda most: F.transform(of, lambda s: F.struct(s["label_id"], s["logit"], F.exp((s["logit"] - most) / F.lit(temperature)).alias("e"))))

    def shares(of: Column) -> Column:
        total = F.aggregate(of, F.lit(0.0), lambda t, s: t + s["e"])
        return _let(total, lambda t: F.transform(of, lambda s: F.struct(s["label_id"].alias("label_id"), s["logit"].alias("logit"), (s["e"] / t).alias("p"))))

    every = vectors.select("vec_id", "embedding").crossJoin(F.broadcast(packed))
    return every.select("vec_id", _let(norm(x) if cosine else F.lit(1.0), lambda size: _let(logits(size), lambda l: _let(shifted(l), shares))).alias("_s"))


def _as_heads(protos: DataFrame) -> DataFrame:
    return protos.select("label", F.col("prototype").alias("weights"), F.lit(0.0).alias("bias"))


def scores(vectors: DataFrame, protos: DataFrame) -> DataFrame:
    """vec_id, label_id, cosine and p, the softmax over all prototypes at TEMPERATURE. Rows with equal ids are scored each by itself."""
    return _scored(vectors, _as_heads(protos), True, TEMPERATURE).select("vec_id", F.inline("_s")).withColumnRenamed("logit", "cosine")


def head_scores(vectors: DataFrame, heads: DataFrame) -> DataFrame:
    """vec_id, label_id, logit and p of each row, by a linear head of (label, weights, bias) rows, a checked number of labels.

    A null vector has null scores; rows with equal ids are scored each by itself."""
    return _scored(vectors, heads).select("vec_id", F.inline("_s"))


def verdicts(vectors: DataFrame, protos: DataFrame) -> DataFrame:
    """The best label of each vector; 0 (safe) where it is 0 or leads the second by less than MARGIN. Within a row, like the scores."""
    ranked = F.slice(F.array_sort(F.transform("_s", lambda s: F.struct((-s["p"]).alias("last"), s["label_id"].alias("label_id"), s["p"].alias("p")))), 1, 2)
    top = _scored(vectors, _as_heads(protos), True, TEMPERATURE).select("vec_id", ranked.alias("_r")).filter(F.size("_r") > 0)
    best, p, second = F.get("_r", F.lit(0))["label_id"], F.get("_r", F.lit(0))["p"], F.get("_r", F.lit(1))["p"]
    safe = (best == 0) | (p - F.coalesce(second, F.lit(0.0)) < F.lit(MARGIN))
    return top.select("vec_id", F.when(safe, 0).otherwise(best).cast("int").alias("category"), F.when(safe, 0).otherwise(2).cast("int").alias("severity"), F.greatest(F.lit(0.05), F.least(F.lit(0.95), p)).alias("confidence"))


def agreement(pairs: DataFrame, a: str, b: str, floor: float = 0.94) -> DataFrame:
    """Least, mean and most cosine of two vector columns, and whether the least reaches the floor."""
    cos = dot(F.col(a), F.col(b)) / (norm(F.col(a)) * norm(F.col(b)))
    got = pairs.select(cos.alias("c")).agg(F.min("c").alias("least"), F.avg("c").alias("mean"), F.max("c").alias("most"))
    return got.withColumn("passed", F.col("least") >= F.lit(floor))


def train_head(vectors: DataFrame, features: str = "embedding", label: str = "label"):
    """A linear head by weighted logistic regression: each class counts the same in total."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    counts = vectors.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n"), F.count(F.lit(1))).first()  # two numbers
    if total[1] > MOST_PROTOTYPES:
        raise ValueError(f"{total[1]} classes; {MOST_PROTOTYPES} are broadcast at most")
    weighted = vectors.join(F.broadcast(counts), label).withColumn("_w", F.lit(float(total[0])) / (F.lit(float(total[1])) * F.col("_n")))
    ready = weighted.select(array_to_vector(features).alias("features"), F.col(label).cast("double").alias("label"), "_w")
    return LogisticRegression(weightCol="_w", maxIter=50).fit(ready)
