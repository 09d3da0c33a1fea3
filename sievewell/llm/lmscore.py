"""Language-model scores by stupid backoff, as joins of n-grams with count tables.

The model counts the words and word pairs of all documents, each by itself, as hashes of 63 bits:
words below 0, pairs from 0 up. No dictionary exists anywhere; two n-grams of one hash would
share a count, which at a billion n-grams happens to about one in twenty billion of them.
A word w after v scores c(v w) / c(v) where the pair occurs `least` times or more in the corpus,
and else BACKOFF * c(w) / N; the first word of a text scores the latter without BACKOFF.

Summed over a text this is additive: every word adds its backed-off log score, and each
pair of the table adds what it gains over that. So one table, partitioned by the code's hash, holds
the gains of pairs and the log counts of words; exploded words and pairs of documents are joined
to it and summed per document. Pairs are worked in PASSES shares of their hashes, one after another,
and what a share wrote is deleted before the next begins: disk holds one share at a time.

No join has a hot key: the most frequent words (`vocabulary` at most) and pairs (HEAVY at most)
are held by every task and added where a text is read, so that what is left has a small share
each. How many are held changes no score. Words and pairs are counted within each task first.

Cases: texts are lower-cased (A-Z) and split at white space; a text that is null or has no words
has 0 words and a null score; rows with equal ids, or with a null id, are scored as one document of
several texts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from math import log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewell.llm.common import bit_filter, forget, held_by, small_batches, table, written
from sievewell.llm.textarrays import by_bytes, mixed, word_hashes

VOCABULARY, LEAST, BACKOFF = 1 << 18, 2, 0.4
HEAVY = 1 << 18
PASSES = 2  # a power of two
_FLUSH = 1 << 22
_SIGN, _ODD = np.uint64(1 << 63), np.uint64(0x9E3779B97F4A7C15)


class Known:
    """Codes with a value each, for lookups within a task."""

    def __init__(self, rows: DataFrame):
        got = rows.toArrow().sort_by("code")
        self.codes, self.values = got["code"].to_numpy(), got["value"].to_numpy()

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether it is known, its value or 0) for each code."""
        if not len(self.codes):
            return np.zeros(len(codes), bool), np.zeros(len(codes))
        place = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        hit = self.codes[place] == codes
        return hit, np.where(hit, self.values[place], 0.0)


def _words(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, offsets): the words of text i are codes[offsets[i] : offsets[i + 1]]."""
    hashes, offsets = word_hashes(texts)
    return (hashes | _SIGN).view(np.int64), offsets


def _pairs(words: np.ndarray, offsets: np.ndarray, share: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, codes) of the pairs within texts whose hashes are of this share; a pair's place is that of its first word."""
    if len(words) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = words.view(np.uint64)
    codes = (mixed(h[:-1] * _ODD + h[1:]) & ~_SIGN).view(np.int64)
    mine = (codes >> 60) & (PASSES - 1) == share
    last = offsets[1:-1] - 1
    mine[last[(last >= 0) & (last < len(codes))]] = False
    at = np.flatnonzero(mine)
    return at, codes[at]


def step_of() -> Column:
    return F.floor(8 * F.log2("n"))


def most_frequent(counts: DataFrame, most: int) -> Column:
    """Which rows every task holds: those of the largest n, `most` or fewer, cut between two eighths of a power of two."""
    steps = counts.groupBy(step_of().alias("step")).agg(F.count(F.lit(1)).alias("rows")).collect()  # 512 rows at most
    limit = 8 * 64
    for step, rows in sorted(steps, reverse=True):
        most -= rows
        if most < 0:
            break
        limit = step
    return step_of() >= limit


def word_counts(docs: DataFrame) -> DataFrame:
    """(code, n) of the words of all documents; counted within each task before any shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held, size = [], 0

        def counted() -> tuple[np.ndarray, np.ndarray]:
            more, n = np.unique(np.concatenate(held), return_counts=True)
            both, at = np.unique(np.concatenate([codes, more]), return_inverse=True)
            return both, np.bincount(at, np.concatenate([counts, n]), len(both)).astype(np.int64)

        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in by_bytes(texts):
                held.append(_words(texts[part])[0])
                size += len(held[-1])
                if size > _FLUSH:
                    codes, counts = counted()
                    held, size = [], 0
                    if len(codes) > _FLUSH:
                        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], ["code", "n"])
                        codes, counts = codes[:0], counts[:0]
        if held:
            codes, counts = counted()
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], ["code", "n"])

    return docs.select("text").mapInArrow(work, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def pair_counts(docs: DataFrame, logs: Known, share: int) -> DataFrame:
    """(code, v, w, logs, n) of the pairs of a share: logs sums the log counts of those of its words that are known; v and w are the others' codes."""
    names = ["code", "v", "w", "logs", "n"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            code, v, w = (np.concatenate([h[i] for h in held]) for i in range(3))
            order = np.argsort(code)
            code = code[order]
            first = np.flatnonzero(np.diff(code, prepend=-1))  # pairs are 0 or more
            n = np.diff(first, append=len(code))
            code, v, w = code[first], v[order[first]], w[order[first]]
            (v_hit, v_log), (w_hit, w_log) = logs.find(v), logs.find(w)
            columns = [pa.array(code), pa.array(v, mask=v_hit), pa.array(w, mask=w_hit), pa.array(v_log + w_log), pa.array(n.astype(np.int64))]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in by_bytes(texts):
                words, offsets = _words(texts[part])
                at, code = _pairs(words, offsets, share)
                held.append((code, words[at], words[at + 1]))
                size += len(code)
                if size > _FLUSH:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    rows = docs.select("text").mapInArrow(work, "code long, v long, w long, logs double, n long")
    return rows.groupBy("code").agg(F.max("v").alias("v"), F.max("w").alias("w"), F.max("logs").alias("logs"), F.sum("n").alias("n"))


def _gains(counted: DataFrame, rare: DataFrame, at_once: float) -> DataFrame:
    """(code, n, value) of pairs: what one adds to the backed-off score of its second word."""
    known = F.isnull("v") & F.isnull("w")
    ready, rest, log_counts = counted.filter(known), counted.filter(~known), F.col("logs")
    for c in ("v", "w"):
        own = rare.select(F.col("code").alias("key"), F.col("value").alias("log_" + c))
        rest = rest.withColumn("key", F.coalesce(c, "code")).join(own, "key", "left").drop("key")  # no word has a pair's code
        log_counts = log_counts + F.coalesce("log_" + c, F.lit(0.0))
    both = ready.unionByName(rest.withColumn("logs", log_counts).select(*ready.columns))
    return both.select("code", "n", (F.log("n") - F.col("logs") + F.lit(at_once)).alias("value"))


def _sums(docs: DataFrame, logs: Known, heavy: Known, table: DataFrame, share: int, base: float) -> DataFrame:
    """(doc_id, n_words, sum) of what the pairs of a share add to documents; the words too with the first share."""
    bits = bit_filter(table.select("code"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seed = (TaskContext.get().partitionId() + 1) << 32
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in by_bytes(texts):
                words, offsets = _words(texts[part])
                at, codes = _pairs(words, offsets, share)
                rows = np.searchsorted(offsets, at, "right") - 1
                hit, gain = heavy.find(codes)
                own = np.zeros(part.stop - part.start) + np.bincount(rows[hit], gain[hit], part.stop - part.start)
                n = np.zeros(part.stop - part.start, np.int64)
                rows, codes = rows[~hit], codes[~hit]
                if share == 0:
                    n = np.diff(offsets)
                    of = np.repeat(np.arange(len(n)), n)
                    hit, value = logs.find(words)
                    own += np.bincount(of, value, len(n)) + base * n - log(BACKOFF) * (n > 0)
                    rows, codes = np.concatenate([rows, of[~hit]]), np.concatenate([codes, words[~hit]])
                may = held_by(bits, codes)  # all others are in no table
                rows, codes = rows[may], codes[may]
                order = np.argsort(codes ^ mixed(rows.astype(np.uint64)).view(np.int64))  # equal ones of one text meet
                rows, codes = rows[order], codes[order]
                first = np.flatnonzero((np.diff(rows, prepend=-1) != 0) | (np.diff(codes, prepend=0) != 0))
                times = np.diff(first, append=len(rows))
                rows, codes = rows[first], codes[first]
                alone = mixed((np.arange(len(n)) + seed).astype(np.uint64)).view(np.int64)  # codes of the texts' own rows, each another
                seed += len(n)
                columns = [
                    batch.column("doc_id").slice(part.start, len(n)).take(pa.array(np.concatenate([np.arange(len(n)), rows]))),
                    pa.array(np.concatenate([alone, codes])),
                    pa.array(np.concatenate([np.zeros(len(n), np.int32), times.astype(np.int32)])),
                    pa.array(np.concatenate([n, np.zeros(len(rows), np.int64)])),
                    pa.array(np.concatenate([own, np.zeros(len(rows))])),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "code", "times", "n_words", "own"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, code long, times int, n_words long, own double")
    joined = rows.join(table, "code", "left")
    return joined.groupBy("doc_id").agg(F.sum("n_words").alias("n_words"), F.sum(F.col("own") + F.coalesce(F.col("times") * F.col("value"), F.lit(0.0))).alias("sum"))


def scores(docs: DataFrame, vocabulary: int = VOCABULARY, least: int = LEAST) -> DataFrame:
    """doc_id, n_words and score, the mean log probability of a word, for each doc_id; tasks hold the counts of `vocabulary` words at most."""
    small_batches()
    words = written(word_counts(docs), "lm-words")
    total = words.agg(F.sum("n")).first()[0] or 0
    log_total = log(max(total, 1))
    held = most_frequent(words, vocabulary)
    values = words.select("code", "n", F.log("n").alias("value"))
    logs = Known(values.filter(held).select("code", "value"))
    rare = values.filter(~held & (F.col("n") > 1)).select("code", "value")  # the log of 1 is 0
    parts = []
    for share in range(PASSES):
        counted = written(pair_counts(docs, logs, share).filter(F.col("n") >= least), "lm-counts")
        pairs = written(_gains(counted, rare, log_total - log(BACKOFF)), "lm-pairs")
        forget(counted)
        held = most_frequent(pairs, HEAVY)
        heavy = Known(pairs.filter(held).select("code", "value"))
        light = pairs.filter(~held).select("code", "value")
        light = light.unionByName(rare) if share == 0 else light
        parts.append(written(_sums(docs, logs, heavy, light, share, log(BACKOFF) - log_total), "lm-sums"))
        forget(pairs)
    forget(words)
    whole = reduce(DataFrame.unionByName, parts).groupBy("doc_id").agg(F.sum("n_words").alias("n_words"), F.sum("sum").alias("sum"))
    return whole.select("doc_id", "n_words", F.when(F.col("n_words") > 0, F.round(F.col("sum") / F.col("n_words"), 6)).alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), t AS (
  SELECT rid, doc_id, i, w[i] AS w FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)
), n AS (
  SELECT w, count(*) AS n FROM t GROUP BY w
), p AS (
  SELECT rid, doc_id, i, w, lag(w) OVER (PARTITION BY rid ORDER BY i) AS v FROM t
), b AS (
  SELECT v, w, count(*) AS n FROM p WHERE v IS NOT NULL GROUP BY v, w HAVING count(*) >= {LEAST}
), s AS (
  SELECT doc_id, CASE WHEN b.n IS NOT NULL THEN ln(b.n) - ln(nv.n)
    ELSE ln(nw.n) - ln((SELECT sum(n) FROM n)) + CASE WHEN p.v IS NULL THEN 0 ELSE ln({BACKOFF}) END END AS x
  FROM p LEFT JOIN b ON b.v = p.v AND b.w = p.w LEFT JOIN n nv ON nv.w = p.v JOIN n nw ON nw.w = p.w
), g AS (
  SELECT doc_id, count(*) AS n, sum(x) AS x FROM s GROUP BY doc_id
)
SELECT u.doc_id, coalesce(g.n, 0)::BIGINT AS n_words, round(g.x / g.n, 6) AS score
FROM (SELECT DISTINCT doc_id FROM documents) u LEFT JOIN g ON g.doc_id IS NOT DISTINCT FROM u.doc_id"""
