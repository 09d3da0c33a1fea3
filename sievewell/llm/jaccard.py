"""N-gram Jaccard join: all documents linked by the similarity of their shingle sets, and their groups.

A size-aware heavy-light join. Documents with equal sets are one class; classes, not
copies, are joined. Small sets emit every subset of the sizes that two linked small sets
must share. Large sets emit the first shingles of a global order, rarest first, and are
found by scanning the inverted lists of these. The boundary between small and large is the
one of least cost for the histogram of set sizes.

The order comes from a count sketch of fixed size over all documents, so that a passage
shared by many documents is at its end and has no long lists. Lists are worked in two steps:
each member is compared with the list's head, the class with the fewest rare shingles, and
what that links becomes one component; only pairs of different components are compared in
the second. Large groups of near copies thus cost links in proportion to their size.
Pairs whose sets must differ in too many elements by a signature of fixed size, the number of
elements in each of CELLS ranges of hashes, go first; signatures of linked sets never do.
All other comparisons are exact, by sets of 64-bit hashes of whole texts.

Most of the first shingles are in one class only. So they are exchanged twice: first by themselves,
16 bytes each, to learn which are in two classes or more, and then, with all that is known of
their places, only those that a filter of these lets through. Filters have BITS bits at most; beyond
about BITS / 16 entries they let more through, and the exact joins behind them do the rest.

Cases: a text that is null or has no words has an empty set, is linked with nothing and is
its own component; fewer words than a shingle has are one shingle; rows with equal ids
are separate rows of one id; null ids keep their rows, and a component is the least id
that is not null; other columns of the input are ignored by `join` and kept by `deduplicated`,
which decides by row: of a group the row of least id (null last) stays, of several such
rows the one whose set, and then whose whole row, has the least hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewell.llm.common import bit_filter, forget, held_by, small_batches, table, written
from sievewell.llm.components import components
from sievewell.llm.textarrays import by_bytes, mixed, shingle_sets

BUCKETS = 1 << 17  # of the count sketch
CELLS = 128  # of a signature, a byte each
LIST_COST = 8  # of a posting in an inverted list, in subset keys
MOST_SMALL = 40


class Threshold:
    """Linked when den * |A & B| >= num * |A | B|."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def overlap(self, a: int, b: int) -> int:
        """The least common elements of linked sets of sizes a and b."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def apart(self, a: int, b: int) -> int:
        """The most elements that are in one only of two linked sets of sizes a and b."""
        return a + b - 2 * self.overlap(a, b)

    def least(self, n: int) -> int:
        """The least size of a set linked with one of size n."""
        return max(1, -(-self.num * n // self.den))

    def probe(self, n: int) -> int:
        """So many first elements of a set of size n meet every linked set's."""
        return n - self.overlap(n, self.least(n)) + 1

    def index(self, n: int) -> int:
        """The same, of sets at least as large."""
        return n - self.overlap(n, n) + 1

    def subset_sizes(self, n: int, most: int) -> list[int]:
        """Sizes of the subsets that a set of size n shares with linked sets of size `most` or less."""
        sizes = {self.overlap(n, m) for m in range(self.least(n), most + 1) if self.least(m) <= n}
        return sorted(c for c in sizes if c <= n)


def _node(found: np.ndarray) -> np.int64:
    return mixed(np.atleast_1d(found.sum(dtype=np.uint64) + np.uint64(len(found))))[0].view(np.int64)


def _signature(found: np.ndarray) -> bytes:
    """How many elements are in each of CELLS equal ranges of hashes, up to 255."""
    cells = np.bincount((found >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64), minlength=CELLS)
    return np.minimum(cells, 255).astype(np.uint8).tobytes()


def _text_slices(batch: pa.RecordBatch, name: str = "text") -> Iterator[tuple[slice, list]]:
    texts = batch.column(name).to_pylist()
    for at in by_bytes(texts):
        yield at, texts[at]


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """kind 0: a row for each document with its set's size, class and signature; kind 1: sums for the count sketch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "id", "n", "node", "signature"]
        counts, seen = np.zeros(BUCKETS, np.int64), set()
        for batch in batches:
            for at, texts in _text_slices(batch):
                sizes, nodes, cells = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), []
                for i, s in enumerate(shingle_sets(texts, k)):
                    sizes[i], nodes[i] = len(s), _node(s) if len(s) else 0
                    cells.append(_signature(s))
                    if nodes[i] not in seen:
                        seen.add(nodes[i])
                        np.add.at(counts, (s >> np.uint64(47)).astype(np.int64), 1)
                ids = batch.column("doc_id").slice(at.start, at.stop - at.start)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(texts), np.int8)), ids, pa.array(sizes), pa.array(nodes), pa.array(cells, pa.binary())], names)
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(full), np.int8)), pa.array(full), pa.array(counts[full]), pa.array(np.zeros(len(full), np.int64)), pa.nulls(len(full), pa.binary())], names)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return plain.mapInArrow(work, "kind byte, id long, n long, node long, signature binary")


def _boundary(rows: DataFrame, t: Threshold) -> int:
    """The largest size of small sets, of least cost over all boundaries. At most MOST_SMALL counts reach the driver."""
    sizes = {r["n"]: r["count"] for r in rows.filter((F.col("n") > 0) & (F.col("n") <= MOST_SMALL)).groupBy("n").count().collect()}

    def cost(x: int) -> float:
        total = 0.0
        for n, count in sizes.items():
            if n <= x:
                total += count * sum(comb(n, c) for c in t.subset_sizes(n, x))
            if n >= t.least(x + 1):
                total += count * t.probe(n) * (1 + LIST_COST)
        return total

    return min(range(MOST_SMALL), key=lambda x: (cost(x), -x))


def _postings(docs: DataFrame, k: int, t: Threshold, order: np.ndarray, small: int, only: np.ndarray | None = None) -> DataFrame:
    """A row for each subset of small sets and each first shingle of large ones: its token and class, or,
    of the tokens that the filter `only` may hold, its place besides.

    n - pos bounds what two sets meeting here have in common: of a subset its size, of a
    shingle the elements from it on. A class is emitted once by each task that meets it.
    """

    def of(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, tokens, pos, indexed = len(s), [], [], []
        if n <= small:
            total = s.sum(dtype=np.uint64)
            for c in t.subset_sizes(n, small):
                out = [s[list(left)].sum(dtype=np.uint64) for left in combinations(range(n), n - c)]
                tokens.append(mixed(total - np.array(out, np.uint64) + np.uint64(c << 48)))
                pos.append(np.full(len(out), n - c))
                indexed.append(np.ones(len(out), bool))
        if n >= t.least(small + 1):
            first = s[np.argsort(order[(s >> np.uint64(47)).astype(np.int64)], kind="stable")[: t.probe(n)]]
            tokens.append(first)
            pos.append(np.arange(len(first)))
            indexed.append(np.arange(len(first)) < t.index(n))
        return np.concatenate(tokens), np.concatenate(pos), np.concatenate(indexed)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for _, texts in _text_slices(batch):
                got, nodes, sizes = [], [], []
                for s in shingle_sets(texts, k):
                    if len(s) and (node := _node(s)) not in seen:
                        seen.add(node)
                        got.append(of(s))
                        nodes.append(node)
                        sizes.append(len(s))
                if got:
                    each = [len(g[0]) for g in got]
                    tokens, nodes = np.concatenate([g[0] for g in got]), np.repeat(np.array(nodes, np.int64), each)
                    if only is None:
                        yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(nodes)], ["token", "node"])
                        continue
                    hit = held_by(only, tokens)
                    pos, indexed = (np.concatenate([g[i] for g in got]) for i in (1, 2))
                    columns = [tokens.view(np.int64), nodes, np.repeat(np.array(sizes, np.int32), each), pos.astype(np.int32), indexed]
                    yield pa.RecordBatch.from_arrays([pa.array(c[hit]) for c in columns], ["token", "node", "n", "pos", "indexed"])

    return docs.select("text").mapInArrow(work, "token long, node long" + (", n int, pos int, indexed boolean" if only is not None else ""))


def _plausible(pairs: DataFrame, classes: DataFrame, t: Threshold) -> DataFrame:
    """The pairs (a, b) of classes without those that by their signatures differ in too many elements to be linked."""
    x, y = (classes.select(F.col("node").alias(a), F.col("n").alias(n), F.col("signature").alias(s)) for a, n, s in (("a", "n", "x"), ("b", "m", "y")))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int16) for c in ("x", "y"))
                n, m = (batch.column(c).to_numpy() for c in ("n", "m"))
                yield batch.select(["a", "b"]).filter(pa.array(np.abs(x - y).sum(axis=1) <= t.apart(n, m)))

    return pairs.join(x, "a").join(y, "b").select("a", "b", "n", "m", "x", "y").mapInArrow(near, "a long, b long")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, t: Threshold) -> DataFrame:
    """The pairs (a, b) of classes whose sets are linked, by their signatures and then by their whole sets.

    The sets are built again from the texts, where a filter of the classes in question is
    at hand: only those are shuffled, never all texts.
    """
    pairs = written(_plausible(pairs, classes, t), "jaccard-plausible")
    wanted = written(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "jaccard-wanted")
    bits = bit_filter(wanted)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for _, texts in _text_slices(batch):
                nodes, elements = [], []
                for s in shingle_sets(texts, k):
                    if len(s) and (node := _node(s)) not in seen and held_by(bits, np.atleast_1d(node))[0]:
                        seen.add(node)
                        nodes.append(node)
                        elements.append(s.tobytes())
                if nodes:
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(nodes, np.int64)), pa.array(elements, pa.binary())], ["node", "elements"])

    sets = docs.select("text").mapInArrow(build, "node long, elements binary").join(wanted, "node", "left_semi").dropDuplicates(["node"])
    sets = written(sets, "jaccard-sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("x")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("elements").alias("y")), "b").select("a", "b", "x", "y")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            for i in range(len(batch)):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in ("x", "y"))
                keep[i] = len(np.intersect1d(x, y, assume_unique=True)) >= t.overlap(len(x), len(y))
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    out = written(both.mapInArrow(compare, "a long, b long"), "jaccard-links")
    forget(pairs, wanted, sets)
    return out


def _fits(t: Threshold, a: str, b: str):
    """Whether sets a and b, met at a posting of each, can be linked."""
    n, m = F.col(f"{a}.n").cast("long"), F.col(f"{b}.n").cast("long")
    shared = F.least(n - F.col(f"{a}.pos"), m - F.col(f"{b}.pos"))
    sizes = (t.den * F.least(n, m)) >= (t.num * F.greatest(n, m))
    return sizes & (shared * (t.num + t.den) >= t.num * (n + m))


def _grouped(docs: DataFrame, k: int, t: Threshold) -> tuple[DataFrame, DataFrame]:
    """Of each row its id, n and node (its class; 0 for an empty set); of each class its node, least id and component."""
    small_batches()
    both = written(_sets(docs, k), "jaccard-rows")
    rows = both.filter("kind = 0").select("id", "n", "node")
    by_node = both.filter("kind = 0 AND n > 0").groupBy("node")
    classes = written(by_node.agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("signature").alias("signature")), "jaccard-classes")
    sketch = both.filter("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS rows
    order = np.zeros(BUCKETS, np.int64)
    order[sketch["id"].to_numpy()] = sketch["n"].to_numpy()
    small = _boundary(rows, t)

    held = _postings(docs, k, t, order, small).groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
    shared = written(held.filter("lo < hi").select("token"), "jaccard-shared")
    post = written(_postings(docs, k, t, order, small, bit_filter(shared)), "jaccard-postings")
    forget(shared)

    at = F.struct("pos", "n", "node")
    heads = post.groupBy("token").agg(F.min(at).alias("head"), F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select("token", "head")
    lists = post.join(heads, "token")  # of two classes or more
    spoke = lists.alias("s").filter((F.col("s.node") != F.col("s.head.node")) & _fits(t, "s", "s.head"))
    stars = written(spoke.select(F.least("s.node", "s.head.node").alias("a"), F.greatest("s.node", "s.head.node").alias("b")).distinct(), "jaccard-stars")
    links = _verified(stars, classes, docs, k, t)

    found = components(links)
    known = post.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    known = written(known, "jaccard-known")
    forget(post)
    split = known.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("token")
    rest = written(known.join(split, "token", "left_semi").distinct(), "jaccard-rest")
    forget(known)
    x, y = rest.filter("indexed").alias("x"), rest.alias("y")
    smaller = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.node") < F.col("y.node")))
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.component") != F.col("y.component")) & smaller & _fits(t, "x", "y"))
    pairs = pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    pairs = written(pairs.join(stars, ["a", "b"], "left_anti"), "jaccard-pairs")
    forget(stars, rest)
    if not pairs.isEmpty():
        more = _verified(pairs, classes, docs, k, t)
        forget(found)
        found = components(links.union(more))
        forget(more)
    forget(links, pairs)
    return rows, classes.select("node", "least").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of `docs`."""
    rows, classes = _grouped(docs, k, Threshold(num, den))
    classes = written(classes, "jaccard-grouped")
    by_component = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = classes.join(by_component, "component").select("node", "component_id")
    empty = rows.filter("n = 0").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    full = rows.filter("n > 0").join(named, "node").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(empty)


def deduplicated(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of `docs` with all their columns, but one row only of each group.

    Rows whose id no dropped row has, by a filter of these ids, never leave their task; the texts of the others are shuffled."""
    rows, classes = _grouped(docs, k, Threshold(num, den))
    classes = written(classes, "jaccard-grouped")
    best = classes.groupBy("component").agg(F.min(F.struct(F.col("least").isNull().alias("last"), "least", F.col("node").alias("stays"))).alias("best"))
    chosen = classes.join(best, "component").select("node", (F.col("node") == F.col("best.stays")).alias("stays"), "best.least")
    by_key = rows.filter("n > 0").groupBy("id", "node").agg(F.count(F.lit(1)).alias("copies")).join(chosen, "node")
    keys = by_key.select("id", "node", "copies", (F.col("stays") & F.col("id").eqNullSafe(F.col("least"))).alias("stays")).filter("copies > 1 OR NOT stays")
    keys = written(keys, "jaccard-keys")
    bits = bit_filter(keys.select(F.xxhash64("id").alias("h")))

    @F.arrow_udf("boolean")
    def named(hashes: pa.Array) -> pa.Array:
        return pa.array(held_by(bits, hashes.to_numpy(zero_copy_only=False)))

    @F.arrow_udf("long")
    def node_of(texts: pa.Array) -> pa.Array:
        texts = texts.to_pylist()
        return pa.array([_node(s) if len(s) else 0 for part in by_bytes(texts) for s in shingle_sets(texts[part], k)], pa.int64())

    row = [docs[f"`{c}`"] for c in docs.columns]
    hashed = named(F.xxhash64(docs["doc_id"].cast("long")))
    plain = [docs[f"`{f.name}`"] for f in docs.schema if "map<" not in f.dataType.simpleString()]
    near = docs.filter(hashed).select(F.struct(*row).alias("_row"), docs["doc_id"].cast("long").alias("_id"), node_of(docs["text"]).alias("_node"), F.xxhash64(*plain).alias("_hash"))
    gone = keys.filter("NOT stays").select("id", "node")
    near = near.join(gone, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_node") == F.col("node")), "left_anti")
    if not keys.filter("stays").isEmpty():
        once = near.filter("_node <> 0").groupBy("_id", "_node").agg(F.min_by("_row", "_hash").alias("_row"))
        near = near.filter("_node = 0").select("_row").unionByName(once.select("_row"))
    return docs.filter(~hashed).select(*row).unionByName(near.select("_row.*"))


def query(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


#: Pairs by common shingles; components by repeated minima along links.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), l AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
  JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, nx.n, ny.n HAVING 100 * count(*) >= 90 * (nx.n + ny.n - count(*))
), r AS (
  SELECT doc_id AS a, doc_id AS c FROM w
  UNION
  SELECT l.b AS a, r.c FROM r JOIN l ON l.a = r.a
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(c) FROM r WHERE r.a = w.doc_id)::BIGINT AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id"""
