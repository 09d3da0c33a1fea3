"""Quality classifier: Naive Bayes support vectors over n-gram indicators.

A document's features say which n-grams it has: runs of 1 to 4 bytes of the whole text,
and runs of 1 to 4 words each marked as equal to the word before it or not. Indicators are
hashed to FEATURES columns, scaled by the log ratio of their smoothed counts in the two
classes, and brought to length one. A linear hinge-loss model is fitted to them by dual
coordinate descent, and its margins are turned into probabilities by a logistic fit on rows
that it has not seen. It learns from at most `per_class` labelled rows of each class, of
which the hashed features alone reach the driver.

Cases: a null text counts as an empty one, which has no n-gram and gets the score of the
bias alone; rows with equal ids are scored one by one; null labels, and labels of ids that
no document has, are not learned from; with no row of one of the classes every score is
the share of the other (0.5 without any); other columns of the input are left as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewell.llm.common import small_batches, table
from sievewell.llm.textarrays import by_bytes, word_hashes

BITS = 17
FEATURES = 1 << BITS
BYTE_ORDERS, WORD_ORDERS = (1, 2, 3, 4), (1, 2, 3, 4)
_MULT = np.uint32(0x9E3779B1)


def _hashed(codes: np.ndarray, order: int) -> np.ndarray:
    return ((codes ^ np.uint32(order * 0x85EBCA6B & 0xFFFFFFFF)) * _MULT) >> np.uint32(32 - BITS)


def features(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The sorted numbers of the features that each whole text has."""
    hashes, offsets = word_hashes(texts, lower=False)
    again = np.concatenate([[False], hashes[1:] == hashes[:-1]]).astype(np.uint32)
    seen = np.zeros(FEATURES, bool)
    for t, a, b in zip(texts, offsets[:-1], offsets[1:], strict=True):
        raw = np.frombuffer((t or "").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
        code = np.zeros(len(raw), np.uint32)
        for n in BYTE_ORDERS:
            if len(raw) >= n:
                code = (code[: len(raw) - n + 1] << np.uint32(8)) | raw[n - 1 :]
                seen[_hashed(code, n)] = True
        mark = again[a:b].copy()
        mark[:1] = 0
        code = np.ones(len(mark), np.uint32)
        for n in WORD_ORDERS:
            if len(mark) >= n:
                code = (code[: len(mark) - n + 1] << np.uint32(1)) | mark[n - 1 :]
                seen[_hashed(code, 100 + n)] = True
        found = np.flatnonzero(seen)
        seen[found] = False
        yield found.astype(np.int32)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of each indicator, log-count ratio times fitted weight
    scale: np.ndarray  # squared log-count ratios, for the length of a row
    bias: float
    slope: float
    shift: float

    def score(self, found: np.ndarray) -> float:
        length = float(np.sqrt(self.scale[found].sum())) if len(found) else 0.0
        margin = self.bias + (float(self.weights[found].sum()) / length if length else 0.0)
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30))))


def _descend(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray, passes: int, seed: int) -> tuple[np.ndarray, float]:
    """Weights and bias of min |w|^2/2 + sum(cost * hinge), by dual coordinate descent over rows of length one."""
    w, bias, alpha = np.zeros(FEATURES), 0.0, np.zeros(len(y))
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        most = 0.0
        for i in rng.permutation(len(y)):
            at, x = rows[i]
            slope = y[i] * (float(x @ w[at]) + bias) - 1
            new = min(max(alpha[i] - slope / 2.0, 0.0), cost[i])  # |x|^2 is one, and one more for the bias
            if change := new - alpha[i]:
                alpha[i], step = new, change * y[i]
                w[at] += step * x
                bias += step
                most = max(most, abs(change))
        if most < 1e-3:
            break
    return w, bias


def _logistic(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and shift of a logistic curve through the margins, by Newton's steps with a weak prior."""
    n1, n0 = good.sum(), (~good).sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        q = p * (1 - p)
        g = np.array([((p - target) * margin).sum() + 1e-3 * a, (p - target).sum() + 1e-3 * b])
        h = np.array([[(q * margin**2).sum() + 1e-3, (q * margin).sum()], [(q * margin).sum(), q.sum() + 1e-3]])
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
    return max(float(a), 0.0), float(b)


def train(found: list[np.ndarray], good: np.ndarray, smooth: float = 1.0, cost: float = 1.0, passes: int = 30, seed: int = 11) -> Model:
    if good.all() or not good.any():
        share = float(good.mean()) if len(good) else 0.5
        return Model(np.zeros(FEATURES), np.zeros(FEATURES), 0.0, 0.0, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    counts = [np.full(FEATURES, smooth), np.full(FEATURES, smooth)]
    for f, g in zip(found, good, strict=True):
        counts[int(g)][f] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())

    def row(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        length = np.sqrt((ratio[f] ** 2).sum())
        return f, ratio[f] / length if length else ratio[f]

    rows, y = [row(f) for f in found], np.where(good, 1.0, -1.0)
    each = np.where(good, cost * len(y) / (2 * good.sum()), cost * len(y) / (2 * (~good).sum()))
    part = np.arange(len(y)) % 4 == 3  # unseen by the model whose margins the logistic curve is fitted to
    if good[part].all() or not good[part].any() or good[~part].all() or not good[~part].any():
        part = np.ones(len(y), bool)
        w, bias = _descend(rows, y, each, passes, seed)
    else:
        w, bias = _descend([rows[i] for i in np.flatnonzero(~part)], y[~part], each[~part], passes, seed)
    margin = np.array([float(rows[i][1] @ w[rows[i][0]]) + bias for i in np.flatnonzero(part)])
    slope, shift = _logistic(margin, good[part])
    w, bias = _descend(rows, y, each, passes, seed)
    return Model(w * ratio, ratio**2, bias, slope, shift)


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, per_class: int = 1500) -> Model:
    """Learns `labels.quality` from the rows where `may_learn` holds: of each class the `per_class` documents whose ids hash lowest."""
    small_batches()
    spark = docs.sparkSession
    able = labels.filter(may_learn & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = [able.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for q in (0, 1)]
    rows = [(r["doc_id"], r["quality"]) for part in chosen for r in part.collect()]  # per_class rows of two numbers
    sample = spark.createDataFrame(rows, "doc_id long, quality int")
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = [f.tobytes() for f in features(pdf["text"].tolist())]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "quality": pdf["quality"], "found": parts})

    once = texts.mapInPandas(counted, "doc_id long, quality int, found binary").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("found").alias("found"))
    rows = once.toPandas().sort_values("doc_id")  # of a bounded sample, of FEATURES numbers at most each, however often an id occurs
    order = np.random.default_rng(5).permutation(len(rows))
    found = [np.frombuffer(rows["found"].iloc[i], np.int32) for i in order]
    return train(found, rows["quality"].to_numpy()[order] == 1)


def score(model: Model, text: Column) -> Column:
    """The probability of label 1 for each whole text."""
    small_batches()

    @F.pandas_udf("double")
    def judge(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            texts = s.tolist()
            yield pd.Series([model.score(f) for at in by_bytes(texts) for f in features(texts[at])], dtype=float)

    return judge(text)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), ~held_out())
    scored = docs.select("doc_id", held_out().alias("held_out"), score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
