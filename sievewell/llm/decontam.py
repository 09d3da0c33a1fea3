"""Benchmark decontamination: every passage of every document is a query to a BM25 index of the test items.

Passages are runs of 2 * half words, each beginning half a passage after the one before,
where half is at least HALF and no less than the longest item, so that an item lies whole in
one passage. Scores are BM25 over the distinct words of a passage, divided by the item's own
score, so that one threshold serves all items. Bounds of blocks of items are summed for all
passages of a text at once; passages that some block may still match are searched by
block-max WAND; what scores above the threshold is verified by what the passage repeats in runs of
words: half of the whole item, or half of its question and half of its answer (its last sentence).
Runs have RUN words; those of a short whole item are shorter, so that one changed word breaks at most half of them.

The index is small data of a stated size: test items are dealt by length, as one long item would make the passages of
all longer, and by hash to shards of about SHARD_BYTES of text, so that blocks stay small and their bounds tight. Tasks
build the shards' indexes, arrays of numbers, and write them; those of up to PASS_BYTES go through the driver to the tasks at a
time, and every document meets every shard, in as many passes as that takes. If there are more than one, what a pass found is
written before the next is read. Word statistics are those of all items.

Cases: null and empty texts and items match nothing; an item of fewer than RUN words is
one run; an item of one sentence has its last third as answer; equal items are reported
each by its id, and an item id that is null is kept; rows with equal document ids are
searched one by one; other columns are left as they are.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewell.llm.common import forget, small_batches, table, written

HALF, RUN, BLOCK, MOST_BLOCKS = 64, 5, 4, 256
K1, B = 1.2, 0.75
THRESHOLD, OVERLAP = 0.5, 0.5
SHARD_BYTES, PASS_BYTES = 256 << 10, 64 << 20
FOUND = "array<struct<item_id bigint, score double, question_overlap double, answer_overlap double>>"
_WORDS = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


def runs(codes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the runs of `n` of a text's words, given as numbers; runs with a word of number -1 are left out."""
    if not 0 < n <= len(codes):
        return np.zeros(0, np.uint64)
    windows = np.lib.stride_tricks.sliding_window_view(codes, n)
    windows = windows[windows.min(axis=1) >= 0].astype(np.uint64)
    out = np.zeros(len(windows), np.uint64)
    for j in range(n):
        out = (out ^ (windows[:, j] + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def run_size(n: int) -> int:
    """The length of runs of a whole item of n words: one changed word breaks no more than half of them if n is 5 or more."""
    return RUN if n >= 3 * RUN - 1 else 3 if n >= 8 else 2 if n >= 5 else n


def parts(text: str) -> tuple[list[str], list[str]]:
    """Question and answer of an item, as words: its last sentence answers what is before."""
    cuts = [m.end() for m in re.finditer(r"[.!?\n]+\s*", text.rstrip().rstrip(".!?"))]
    if cuts and (q := tokens(text[: cuts[-1]])) and (a := tokens(text[cuts[-1] :])):
        return q, a
    words = tokens(text)
    cut = len(words) - len(words) // 3
    return words[:cut], words[cut:]


@dataclass(frozen=True)
class Runs:
    """Runs of words of each item: their length, and their hashes one item after another."""

    n: np.ndarray
    start: np.ndarray
    hashes: np.ndarray

    @classmethod
    def of(cls, texts: list[tuple[np.ndarray, int]]) -> Runs:
        found = [runs(codes, min(most, len(codes))) for codes, most in texts]
        n = np.array([min(most, len(codes)) for codes, most in texts], np.int8)
        return cls(n, np.cumsum([0, *map(len, found)]), np.concatenate([np.zeros(0, np.uint64), *found]))

    def share(self, item: int, have: dict[int, np.ndarray], passage: np.ndarray) -> float:
        """The share of an item's runs that a passage has; `have` keeps the passage's runs of each length."""
        mine, n = self.hashes[self.start[item] : self.start[item + 1]], int(self.n[item])
        if not len(mine):
            return 1.0
        if n not in have:
            have[n] = runs(passage, n)
        return float(np.isin(mine, have[n]).mean())


@dataclass(frozen=True)
class Index:
    ids: list
    half: int
    vocabulary: dict[str, int]
    start: np.ndarray  # where each word's postings begin
    items: np.ndarray
    impacts: np.ndarray
    block: int
    block_start: np.ndarray  # where each word's blocks begin: those that have an item with it
    blocks: np.ndarray
    bounds: np.ndarray  # the largest impact of the word in the block
    question: Runs
    answer: Runs
    whole: Runs

    def packed(self) -> bytes:
        """The index without its classes, since tasks have their own copies of these."""
        return pickle.dumps({k: vars(v) if isinstance(v, Runs) else v for k, v in vars(self).items()})

    @classmethod
    def unpacked(cls, data: bytes) -> Index:
        return cls(**{k: Runs(**v) if k in ("question", "answer", "whole") else v for k, v in pickle.loads(data).items()})

    @property
    def n_blocks(self) -> int:
        return max(1, -(-len(self.ids) // self.block))

    def posting(self, word: int) -> tuple[list[int], list[float], float]:
        """A word's items in order, their impacts, and the largest."""
        x = self.impacts[self.start[word] : self.start[word + 1]].tolist()
        return self.items[self.start[word] : self.start[word + 1]].tolist(), x, max(x, default=0.0)

    def _entries(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many blocks each word has, and the places of these in `blocks`."""
        sizes = self.block_start[words + 1] - self.block_start[words]
        return sizes, np.repeat(self.block_start[words] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())

    def bound(self, words: np.ndarray) -> np.ndarray:
        """The largest impact of each word in each block."""
        sizes, at = self._entries(words)
        out = np.zeros((len(words), self.n_blocks), np.float32)
        out[np.repeat(np.arange(len(words)), sizes), self.blocks[at]] = self.bounds[at]
        return out

    def sums(self, rows: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
        """The summed bounds (n, blocks) of the words of each row, given as pairs of row and word."""
        sizes, at = self._entries(words)
        return np.bincount(np.repeat(rows, sizes) * self.n_blocks + self.blocks[at], self.bounds[at], n * self.n_blocks).reshape(n, self.n_blocks)


def build(items: list[tuple[int | None, str]], df: dict[str, int], total: int, mean: float, longest: int) -> Index:
    """The index of some items, with the word statistics of all."""
    vocabulary, lists, question, answer, whole, ids = {}, [], [], [], [], []

    def numbered(words: list[str]) -> np.ndarray:
        for w in words:
            if vocabulary.setdefault(w, len(lists)) == len(lists):
                lists.append(([], []))
        return np.fromiter((vocabulary[w] for w in words), np.int64, len(words))

    for item, text in sorted(items, key=lambda x: (x[0] is None, x[0], x[1])):
        words = tokens(text)
        if not words:
            continue
        whole.append((numbered(words), run_size(len(words))))
        counts = Counter(words)
        idf = {w: np.log(1 + (total - df[w] + 0.5) / (df[w] + 0.5)) for w in counts}
        impact = {w: idf[w] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(words) / mean)) for w, n in counts.items()}
        own = sum(impact.values())
        for w, x in impact.items():
            at, mine = lists[vocabulary[w]]
            at.append(len(ids))
            mine.append(float(x / own))
        ids.append(item)
        q, a = parts(text)
        question.append((numbered(q), RUN))
        answer.append((numbered(a), RUN))
    block = max(BLOCK, -(-len(ids) // MOST_BLOCKS))
    start = np.cumsum([0, *(len(at) for at, _ in lists)])
    at = np.array([i for own, _ in lists for i in own], np.int32)
    impacts = np.array([x for _, own in lists for x in own], np.float64)
    words = np.repeat(np.arange(len(lists)), np.diff(start))
    key, where = np.unique(words * (1 << 32) + at // block, return_inverse=True)
    bounds = np.zeros(len(key), np.float32)
    np.maximum.at(bounds, where, impacts.astype(np.float32))
    block_start = np.searchsorted(key, np.arange(len(lists) + 1) << 32)
    return Index(ids, max(HALF, longest), vocabulary, start, at, impacts, block, block_start, (key & 0xFFFFFFFF).astype(np.int32), bounds, Runs.of(question), Runs.of(answer), Runs.of(whole))


def search(index: Index, words: list[int], threshold: float) -> list[tuple[int, float]]:
    """All items that score `threshold` or more for the distinct `words`, by block-max WAND."""
    found, slack = [], 1e-6
    rows = index.bound(np.array(words, np.int64))
    open_ = np.flatnonzero(rows.sum(axis=0) >= threshold - 1e-3).tolist()  # blocks that all words together may match
    if not open_:
        return found
    may = set(open_)
    lists = [[*index.posting(w), 0, row] for w, row in zip(words, rows, strict=True)]  # items, impacts, largest, cursor, block bounds
    while True:
        lists = sorted((x for x in lists if x[3] < len(x[0])), key=lambda x: x[0][x[3]])
        total, pivot = 0.0, -1
        for i, x in enumerate(lists):
            total += x[2]
            if total >= threshold - slack:
                pivot = i
                break
        if pivot < 0:
            return found
        item = lists[pivot][0][lists[pivot][3]]
        while pivot + 1 < len(lists) and lists[pivot + 1][0][lists[pivot + 1][3]] == item:
            pivot += 1
        block = item // index.block
        if block not in may:
            after = bisect_left(open_, block)
            if after == len(open_):
                return found
            for x in lists:
                x[3] = bisect_left(x[0], open_[after] * index.block, x[3])
            continue
        if sum(float(x[4][block]) for x in lists[: pivot + 1]) < threshold - slack:
            goal = (block + 1) * index.block  # no item of this block, unless a later list has one
            if pivot + 1 < len(lists):
                goal = min(goal, lists[pivot + 1][0][lists[pivot + 1][3]])
        elif lists[0][0][lists[0][3]] == item:
            score = sum(x[1][x[3]] for x in lists[: pivot + 1])
            if score >= threshold - 1e-9:
                found.append((item, score))
            goal = item + 1
        else:
            goal = item
        for x in lists[: pivot + 1]:
            x[3] = bisect_left(x[0], goal, x[3])


def leaks(index: Index, words: list[str], threshold: float = THRESHOLD, overlap: float = OVERLAP) -> dict[int, tuple[float, float, float]]:
    """Of each item that a text, given as words, repeats: score, question and answer overlap of its best passage."""
    if not words or not index.ids:
        return {}
    known = np.fromiter(map(index.vocabulary.get, words, repeat(-1)), np.int64, len(words))
    at = np.flatnonzero(known >= 0)
    if not len(at):
        return {}
    size, least = len(index.start) - 1, threshold - 1e-3
    halves, terms = np.divmod(np.unique(at // index.half * size + known[at]), size)
    sums = index.sums(halves, terms, len(words) // index.half + 2)
    out: dict[int, tuple[float, float, float]] = {}
    for i in np.flatnonzero((sums[:-1] + sums[1:]).max(axis=1) >= least):
        begin, end = i * index.half, (i + 2) * index.half
        mine = np.unique(known[begin:end])
        mine = mine[mine >= 0]
        hits = search(index, mine.tolist(), threshold)
        have: dict[int, np.ndarray] = {}
        for item, score in hits:
            if score <= out.get(item, (0.0,))[0]:
                continue
            q, a, whole = (r.share(item, have, known[begin:end]) for r in (index.question, index.answer, index.whole))
            if max(min(q, a), whole) >= overlap:
                out[item] = (float(score), q, a)
    return out


def index_rows(items: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame | None:
    """cls, shard, size and index (pickled): the indexes of all items of (item_id, text), each of about `shard_bytes` of text at most."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(words=[list(map(str, tokens(t))) for t in pdf["text"]])

    own = items.select(F.col("item_id").cast("long").cast("string").alias("item_id"), "text").filter(F.col("text").isNotNull())  # pandas has no null integers
    size = F.size("words")
    lengths = F.greatest(F.lit(0), F.ceil(F.log2(size / HALF))).cast("int").alias("cls")
    own = written(own.mapInPandas(split, "item_id string, text string, words array<string>").filter(size > 0).select("*", lengths), "test-items")
    classes = own.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("words"), F.max(size).alias("longest"), F.sum(F.octet_length("text")).alias("bytes")).collect()  # a row each time lengths double
    if not classes:
        return None
    total = sum(r["n"] for r in classes)
    mean = sum(r["words"] for r in classes) / total
    longest = {r["cls"]: r["longest"] for r in classes}
    shards = F.create_map(*[F.lit(x) for r in classes for x in (r["cls"], -(-r["bytes"] // shard_bytes))])
    dealt = own.select("*", F.pmod(F.xxhash64("item_id", "text"), shards[F.col("cls")]).alias("shard"))
    df = own.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    known = dealt.select(F.col("cls").alias("c"), F.col("shard").alias("s"), F.explode(F.array_distinct("words")).alias("word")).distinct().join(df, "word")

    def made(key: tuple, texts: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        pairs = [(None if pd.isna(i) else int(i), t) for i, t in zip(texts["item_id"], texts["text"], strict=True)]
        data = build(pairs, dict(zip(counts["word"], counts["df"].tolist(), strict=True)), total, mean, longest[int(key[0])]).packed()
        return pd.DataFrame({"cls": [key[0]], "shard": [key[1]], "size": [len(data)], "index": [data]})

    parts = dealt.select("cls", "shard", "item_id", "text").groupBy("cls", "shard")
    out = written(parts.cogroup(known.groupBy("c", "s")).applyInPandas(made, "cls int, shard long, size long, index binary"), "test-index")
    forget(own)
    return out


def passes(items: DataFrame, shard_bytes: int = SHARD_BYTES, pass_bytes: int = PASS_BYTES) -> Iterator[tuple[list[Index], bool]]:
    """The indexes of all items, of about `pass_bytes` at a time, and whether these are all."""
    if (rows := index_rows(items, shard_bytes)) is None:
        return
    sizes = rows.select("cls", "shard", "size").orderBy("cls", "shard").collect()  # a row a shard
    groups, full = [], pass_bytes
    for r in sizes:
        if full + r["size"] > pass_bytes:
            groups.append([])
            full = 0
        groups[-1].append((r["cls"], r["shard"]))
        full += r["size"]
    try:
        for group in groups:
            key = F.struct("cls", "shard")
            first, last = (F.struct(F.lit(c).alias("cls"), F.lit(n).cast("long").alias("shard")) for c, n in (group[0], group[-1]))
            got = rows.filter((key >= first) & (key <= last)).orderBy("cls", "shard").select("index").collect()  # a pass
            yield [Index.unpacked(r["index"]) for r in got], len(groups) == 1
    finally:
        forget(rows)


def indexes(items: DataFrame, shard_bytes: int = SHARD_BYTES) -> list[Index]:
    """Indexes of all items, for items that the driver can hold."""
    return [index for group, _ in passes(items, shard_bytes) for index in group]


def found(shards: list[Index], text: Column, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> Column:
    """The items of the indexes that each whole text repeats, as FOUND."""
    small_batches()

    @F.arrow_udf(FOUND)
    def judge(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts:
            words = tokens(t.as_py())
            got = [(index.ids[i], *x) for index in shards for i, x in sorted(leaks(index, words, threshold, overlap).items())]
            rows.append([{"item_id": i, "score": s, "question_overlap": q, "answer_overlap": a} for i, s, q, a in got])
        kind = pa.struct([("item_id", pa.int64()), *[(c, pa.float64()) for c in ("score", "question_overlap", "answer_overlap")]])
        return pa.array(rows, pa.list_(kind))

    return judge(text)


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """doc_id, item_id, score, question_overlap and answer_overlap: a row for each test item that a document repeats."""
    out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")
    for shards, alone in passes(items, pass_bytes=pass_bytes):
        hits = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(found(shards, F.col("text"), threshold, overlap)).alias("f")).select("doc_id", "f.*")
        out = out.unionByName(hits if alone else written(hits, "leaks"))
    return out


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The rows of `docs` that repeat no test item, with all their columns."""
    before = None
    for shards, alone in passes(items, pass_bytes=pass_bytes):
        row = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
        docs = docs.select(row.alias("_row"), found(shards, docs["text"], threshold, overlap).alias("_f")).filter(F.size("_f") == 0).select("_row.*")
        if not alone:
            docs = written(docs, "clean")
            if before is not None:
                forget(before)
            before = docs
    return docs


def query(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
