"""Short codes for vectors: a codebook for each of a vector's parts, trained in integers.

Components become floor(scale * x). A vector is cut into `parts` equal consecutive parts, and
each part position has a codebook of `entries` at most, which starts as the parts of the
smallest vec_ids. Each round assigns every part to its nearest entry (squared Euclidean
distance, ties to the lower index) and moves entries to the floor of the mean of their parts.

Each round sends tasks a kd-tree for each codebook, `parts` times `entries` vectors whatever
the input; they search it by branch and bound, visiting boxes whose bound equals the best
distance too, so that a lower index at the same distance is found. Tasks return integer sums
for each entry, one row for each entry and position, and these are added up by Spark; the new
entries are what reaches the driver. All arithmetic is exact: distances that might leave 64
bits are computed with Python's integers, all others with doubles that hold them exactly.

Cases: rows whose vector is null or holds a null or a component that isn't finite are
dropped; of rows with equal vec_id, the lesser vector comes first; a null vec_id is the
largest; with fewer than `entries` rows the codebook has one entry a row, repeated rows
included; an empty table gives no rows. The length of vectors is that of the smallest vec_id
whose length can be cut into parts; rows of another length have null code and error.
Components beyond a long stand at its end, and so do errors. Null labels are one label.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewell.llm.common import forget, small_batches, table, written

SCALE, PARTS, ENTRIES, ROUNDS, LEAF = 1024, 4, 256, 4, 16
MOST_BROADCAST, _ROWS, _LONG = 100_000, 2048, (1 << 63) - 1


@dataclass
class Node:
    """A box around entries: two halves, or a leaf with the entries' indexes in ascending order."""

    low: np.ndarray
    high: np.ndarray
    entries: np.ndarray
    halves: list[Node] = field(default_factory=list)
    axis: int = 0
    split: int = 0


def kd_tree(book: np.ndarray, entries: np.ndarray | None = None, leaf: int = LEAF) -> Node:
    """Halves at the median of the widest axis, down to `leaf` entries or equal ones."""
    at = np.arange(len(book)) if entries is None else entries
    own = book[at]
    node = Node(own.min(0), own.max(0), np.sort(at))
    wide = node.high - node.low
    axis = int(np.argmax(wide))
    if len(at) > leaf and wide[axis] > 0:
        split = np.sort(own[:, axis])[(len(at) - 1) // 2]
        if split == node.high[axis]:  # more than half share the largest value
            split = own[own[:, axis] < split, axis].max()
        left = own[:, axis] <= split
        node.axis, node.split = axis, split
        node.halves = [kd_tree(book, at[left], leaf), kd_tree(book, at[~left], leaf)]
    return node


def _largest(a: np.ndarray) -> int:
    """The largest absolute value, also of the least long."""
    return max(int(a.max(initial=0)), -int(a.min(initial=0)))


def nearest(tree: Node, book: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry for each of `points`, the lower index of equal ones."""
    n, width = points.shape
    most = max(1, _largest(points), _largest(book))
    quick = 4 * width * (2 * most) ** 2 < 1 << 53  # then doubles hold every number on the way
    points, book = (a.astype(float if quick else object) for a in (points, book))
    best = np.full(n, width * (2 * most) ** 2 + 1, points.dtype)
    squares, own_squares = (book * book).sum(1), (points * points).sum(1)
    at = np.full(n, len(book), np.int64)

    def bound(node: Node, rows: np.ndarray) -> np.ndarray:
        own = points[rows]
        out = np.maximum(np.maximum(node.low - own, own - node.high), 0)
        return (out * out).sum(1)

    def visit(node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if not node.halves:
            far = own_squares[rows, None] - 2 * (points[rows] @ book[node.entries].T) + squares[node.entries]
            first = far.argmin(1)  # of equal ones the first, entries ascend
            least, entry = far[np.arange(len(rows)), first], node.entries[first]
            better = (least < best[rows]) | ((least == best[rows]) & (entry < at[rows]))
            best[rows[better]], at[rows[better]] = least[better], entry[better]
            return
        left = (points[rows, node.axis] <= node.split).astype(bool)
        for near, far, own in ((node.halves[0], node.halves[1], rows[left]), (node.halves[1], node.halves[0], rows[~left])):
            visit(near, own)
            visit(far, own[(bound(far, own) <= best[own]).astype(bool)])

    for i in range(0, n, _ROWS):
        visit(tree, np.arange(i, min(n, i + _ROWS)))
    return at, best.astype(np.int64) if quick else best


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label and v, the components as integers, of rows whose components are all finite."""
    x = F.col("embedding")
    finite = ~F.exists(x, lambda c: F.isnull(c) | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    kept = vectors.select("vec_id", "label", "embedding").filter(F.isnotnull(x) & finite)
    return kept.select("vec_id", "label", F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))


def _moved(rows: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round over `rows`."""
    parts, width = len(books), books[0].shape[1]
    trees = [kd_tree(b) for b in books]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(b.shape, object) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            v = _matrix(batch.column("v"), parts * width)
            exact = _largest(v) < _LONG // (len(v) + 1)
            for p, book in enumerate(books):
                own = v[:, p * width : (p + 1) * width]
                at, _ = nearest(trees[p], book, own)
                more = np.zeros(book.shape, np.int64 if exact else object)
                np.add.at(more, at, own if exact else own.astype(object))
                sums[p] += more.astype(object)
                counts[p] += np.bincount(at, minlength=len(book))
        for p in range(parts):
            used = np.flatnonzero(counts[p])
            columns = [np.full(len(used) * width, p, np.int32), np.repeat(used, width).astype(np.int32), np.tile(np.arange(width, dtype=np.int32), len(used))]
            total = pa.array([str(x) for x in sums[p][used].ravel()], pa.string())
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), total, pa.array(np.repeat(counts[p][used], width))], ["part", "entry", "pos", "total", "n"])

    found = rows.select("v").mapInArrow(work, "part int, entry int, pos int, total string, n long")
    summed = found.groupBy("part", "entry", "pos").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    out = [b.copy() for b in books]
    for r in summed.collect():  # at most one row for each component of the codebooks
        out[r["part"]][r["entry"], r["pos"]] = int(r["total"]) // r["n"]
    return out


def codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """For each part position its entries, trained on the rows of `integers`; none without rows that can be cut."""
    able = rows.filter((F.size("v") > 0) & (F.size("v") % parts == 0))
    order = (F.col("vec_id").asc_nulls_last(), F.col("v"))
    first = able.orderBy(*order).limit(1).collect()
    if not first:
        return []
    size = len(first[0]["v"])
    able = able.filter(F.size("v") == size)
    start = np.array([r["v"] for r in able.orderBy(*order).select("v").limit(entries).collect()], np.int64)
    books = [np.ascontiguousarray(b) for b in np.split(start, parts, axis=1)]
    for _ in range(rounds):
        books = _moved(able, books)
    return books


def sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def encoded(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, codes (an index for each part) and error, for the rows of `integers`."""
    parts, width = len(books), books[0].shape[1]
    trees = [kd_tree(b) for b in books]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lens = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
            fit = lens == parts * width
            v = _matrix(batch.column("v").filter(pa.array(fit)), parts * width)
            codes, error = np.zeros((len(batch), parts), np.int32), np.zeros(len(batch), object)
            for p, book in enumerate(books):
                at, far = nearest(trees[p], book, v[:, p * width : (p + 1) * width])
                codes[fit, p] = at
                error[fit] += far.astype(object)
            listed = pa.array([row.tolist() if ok else None for row, ok in zip(codes, fit)], pa.list_(pa.int32()))
            errors = pa.array([min(int(e), _LONG) if ok else None for e, ok in zip(error, fit)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), listed, errors], ["vec_id", "label", "codes", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(work, f"vec_id {kinds['vec_id']}, label {kinds['label']}, codes array<int>, error long")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, codes and error of each kept row; the codebooks)."""
    small_batches(4096)
    rows = written(integers(vectors, scale), "vector-integers")
    books = codebooks(rows, parts, entries, rounds)
    if not books:
        return rows.select("vec_id", "label", F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("long").alias("error")), books
    coded = written(encoded(rows, books), "vector-codes")
    forget(rows)
    return coded, books


def query(spark, sf_dir: str) -> DataFrame:
    """Codes as two hex digits a part, errors also by label, and the digest of the codebooks."""
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    if by_label.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:  # beyond, the join's own skew handling splits a hot label
        by_label = F.broadcast(by_label)
    code = F.concat_ws("", F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of")), "left").select(
        "vec_id", F.when(F.isnotnull("codes"), code).alias("code"), "error", "label_error", F.lit(sha256(books)).alias("codebooks_sha256"))


def _rounds() -> str:
    """The SQL of all rounds: a(i) is the assignment to the codebooks of c(i)."""
    out = []
    for i in range(ROUNDS + 1):
        out.append(f"""a{i} AS MATERIALIZED (
  SELECT rid, part, p.x, min((list_dot_product(p.x, p.x) - 2 * list_dot_product(p.x, c.x) + list_dot_product(c.x, c.x))::BIGINT * {ENTRIES} + e) AS best
  FROM p JOIN c{i} c USING (part) GROUP BY rid, part, p.x
)""")
        if i < ROUNDS:
            out.append(f"""s{i} AS (
  SELECT part, best % {ENTRIES} AS e, pos, floor(sum(x[pos]) / count(*)) AS x FROM (SELECT *, unnest(range(1, len(x) + 1)) AS pos FROM a{i}) GROUP BY part, e, pos
), c{i + 1} AS MATERIALIZED (
  SELECT part, e, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (SELECT part, e, list(x ORDER BY pos) AS x FROM s{i} GROUP BY part, e) m USING (part, e)
)""")
    return ", ".join(out)


ORACLE = f"""
WITH r AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT rid, part, v[part * len(v) // {PARTS} + 1 : (part + 1) * len(v) // {PARTS}] AS x FROM (SELECT *, unnest(range({PARTS})) AS part FROM r)
), c0 AS MATERIALIZED (
  SELECT part, e, x FROM (SELECT rid, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM r) JOIN p USING (rid) WHERE e < {ENTRIES}
), {_rounds()}, o AS (
  SELECT rid, string_agg(printf('%02x', best % {ENTRIES}), '' ORDER BY part) AS code, sum(best // {ENTRIES})::BIGINT AS error FROM a{ROUNDS} GROUP BY rid
), h AS (
  SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY part, e, pos)) AS h FROM (SELECT part, e, unnest(x) AS x, unnest(range(len(x))) AS pos FROM c{ROUNDS})
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM r JOIN o USING (rid) CROSS JOIN h"""
