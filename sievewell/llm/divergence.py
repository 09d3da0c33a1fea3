"""How far the sources of a language differ in the words they use: an audit over integer-encoded terms.

Terms are runs of letters A-Z, a-z and of characters beyond ASCII, only A-Z lower-cased.
A language keeps the terms that at least `least` of its documents hold. Every (lang, source)
group and every language gives each kept term the smoothed share
p = 1 + floor(scale * (count + prior) / (N + prior * V)), in integers throughout. Part
`pair` sums |p - q| over all kept terms for each two sources of a language; part `term`
lists the terms that a source uses more than its language does, up to rank `top`.

One pass over the texts counts terms, occurrences and documents in tasks; what is shuffled
are their sums, dealt by (lang, term), so that a frequent term is a row of each task and
source. Sources get integer ids, and kept terms are sorted by range into chunks. In a chunk
the kept terms are a sorted array, `searchsorted` gives their ids, and `bincount` the dense
count vectors of all sources; ids keep the order of UTF-8, and so ties fall by id. A chunk
has at most `cells` counts, and sources are compared in blocks of `block`, so that a task's
memory depends on neither the number of terms nor that of a language's sources.

The names and totals of all groups are held by tasks: at most MOST_GROUPS, beyond which the
pair part, whose rows are the square of a language's sources, is refused with an error.

Cases: null text, lang and source are ''; a group without terms has a row for each other
source; without kept terms all sums are 0 and no terms are listed; repeated rows and ids
are documents of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievewell.llm.common import small_batches, table, written

LEAST, PRIOR, SCALE, TOP = 30, 5, 10**9, 50
CELLS, BLOCK, MOST_GROUPS = 1 << 22, 1024, 100_000
_STEP, _FLUSH = 1 << 22, 400_000
_PART = "lang binary, sid int, part string, other int, term binary, value long"
#: What is no byte of a term becomes a space, and A-Z lower case.
_FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def _slices(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, so many at a time; cut only between terms."""
    folded, at = raw.translate(_FOLD), 0
    while at < len(folded):
        end = folded.find(b" ", at + _STEP)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, df): occurrences of a term in a group and the group's documents with it. Each group has a row without term too."""
    small_batches()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, df) in groups.items():
                terms = [b"", *n]
                columns = [pa.array([lang] * len(terms), pa.binary()), pa.array([source] * len(terms), pa.binary()), pa.array(terms, pa.binary())]
                columns += [pa.array([0, *n.values()], pa.int64()), pa.array([0, *(df[t] for t in n)], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "df"])
            groups.clear()

        size = 0
        for batch in batches:
            lang, source, text = (batch.column(c).to_pylist() for c in ("lang", "source", "text"))
            for key, raw in zip(zip(lang, source), text):
                n, df = groups.setdefault(key, (Counter(), Counter()))
                before, own = len(n), set()
                for terms in _slices(raw):
                    n.update(terms)
                    own.update(terms)
                df.update(own)
                size += len(n) - before + 1
                if size > _FLUSH:
                    yield from flushed()
                    size = 0
        yield from flushed()

    own = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary").alias(c) for c in ("lang", "source", "text")])
    rows = own.mapInArrow(work, "lang binary, source binary, term binary, n long, df long").repartition("lang", "term")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def share(n: np.ndarray, total: int, v: int, prior: int = PRIOR, scale: int = SCALE) -> np.ndarray:
    """1 + floor(scale * (n + prior) / (total + prior * v)), exact: `scale` is worked off in thousands, so that nothing leaves 64 bits."""
    by = total + prior * v
    out, rest = np.divmod(n.astype(np.int64) + prior, by)
    while scale > 1:
        step = min(scale, 1000)
        digit, rest = np.divmod(rest * step, by)
        out, scale = out * step + digit, scale // step
    return out + 1


def _dense(sid: np.ndarray, tid: np.ndarray, n: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Counts by source and term; `bincount` sums doubles, so two halves of each count keep it exact."""
    at, half = sid * shape[1] + tid, np.int64(1 << 26)
    low, high = (np.bincount(at, w, shape[0] * shape[1]).astype(np.int64) for w in (n % half, n // half))
    return (low + high * half).reshape(shape)


def audit(docs: DataFrame, least: int = LEAST, prior: int = PRIOR, scale: int = SCALE, top: int = TOP, cells: int = CELLS, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value and rank, as the module says. `scale` is 1 or a power of 1000."""
    spark = docs.sparkSession
    of_term = Window.partitionBy("lang", "term")
    kept = counts(docs).withColumn("held", F.sum("df").over(of_term)).withColumn("all", F.sum("n").over(of_term))
    kept = written(kept.filter((F.col("held") >= least) | (F.col("term") == F.lit(b""))).select("lang", "source", "term", "n", "all"), "divergence-kept")
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("total")).orderBy("lang", "source").limit(MOST_GROUPS + 1).collect()
    if len(groups) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups of lang and source: the pair part would have the square of that")
    sizes = {bytes(r["lang"]): r["v"] for r in kept.filter(F.col("term") != F.lit(b"")).groupBy("lang").agg(F.countDistinct("term").alias("v")).collect()}
    names: dict[bytes, list[bytes]] = {}
    totals: dict[bytes, list[int]] = {}
    for r in groups:
        names.setdefault(bytes(r["lang"]), []).append(bytes(r["source"]))
        totals.setdefault(bytes(r["lang"]), []).append(r["total"])
    ids = [(lang, s, i, (len(of) - 1) // block) for lang, of in names.items() for i, s in enumerate(of)]
    numbered = F.broadcast(spark.createDataFrame(ids, "lang binary, source binary, sid int, last int"))  # MOST_GROUPS rows at most

    def compared(rows: list[pa.Table], lang: bytes, own: range, others: range) -> tuple[np.ndarray | None, list[pa.RecordBatch]]:
        """Sums of |p - q| of one chunk between two blocks of sources, and the terms above their language's share in it."""
        chunk = pa.concat_tables(rows)
        terms = np.array(chunk["term"].to_pylist(), object)
        sid, n, whole = (chunk[c].to_numpy() for c in ("sid", "n", "all"))
        real = np.array([t != b"" for t in terms], bool)
        terms, sid, n, whole = terms[real], sid[real].astype(np.int64), n[real], whole[real]
        if not len(terms):
            return None, []
        ordered = np.array(sorted(set(terms.tolist())), object)
        tid = np.searchsorted(ordered, terms)
        v, held = sizes[lang], totals[lang]
        sides = []
        for side in (own, others) if own != others else (own,):
            here = (sid >= side.start) & (sid < side.stop)
            dense = _dense(sid[here] - side.start, tid[here], n[here], (len(side), len(ordered)))
            sides.append(np.stack([share(dense[i], held[s], v, prior, scale) for i, s in enumerate(side)]))
        p, q = sides[0], sides[-1]
        sums = np.stack([np.abs(q - row).sum(1) for row in p])
        if own != others:
            return sums, []
        of_lang = np.zeros(len(ordered), np.int64)
        of_lang[tid] = whole
        of_lang = share(of_lang, sum(held), v, prior, scale)
        above = p[sid - own.start, tid] - of_lang[tid]
        out, at = [], np.flatnonzero((above > 0) & (n > 0))
        order = at[np.lexsort((tid[at], -above[at], sid[at]))]
        first = np.searchsorted(sid[order], sid[order])  # of the same source
        order = order[np.arange(len(order)) - first < top]
        if len(order):
            out.append(_rows(lang, sid[order], "term", None, ordered[tid[order]], above[order]))
        return sums, out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, held, terms, sums = None, None, [], 0, None

        def ranges() -> tuple[range, range]:
            n = len(names[key[0]])
            return tuple(range(b * block, min(n, (b + 1) * block)) for b in key[1:])

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal sums, held, terms
            own, others = ranges()
            more, out = compared(held, key[0], own, others)
            sums = more if sums is None else sums if more is None else sums + more
            held, terms = [], 0
            yield from out

        def ended() -> Iterator[pa.RecordBatch]:
            nonlocal sums
            yield from done()
            own, others = ranges()
            total = np.zeros((len(own), len(others)), np.int64) if sums is None else sums
            for i, s in enumerate(own):
                for left, right, value in ((np.full(len(others), s), np.array(others), total[i]), (np.array(others), np.full(len(others), s), total[i]))[: 1 + (own != others)]:
                    differ = left != right
                    yield _rows(key[0], left[differ], "pair", right[differ], None, value[differ])
            sums = None

        for batch in batches:
            part = pa.Table.from_batches([batch])
            keys = list(zip(part["lang"].to_pylist(), part["own"].to_pylist(), part["others"].to_pylist()))
            own_terms = part["term"].to_pylist()
            begin = 0
            for i, (k, term) in enumerate(zip(keys, own_terms)):
                full = term != last and terms * sum(map(len, ranges())) >= cells if k == key else key is not None
                if full:
                    held.append(part.slice(begin, i - begin))
                    begin = i
                    yield from done() if k == key else ended()
                if k != key:
                    key, last = k, None
                if term != last:
                    terms, last = terms + 1, term
            held.append(part.slice(begin))
        if key is not None:
            yield from ended()

    blocks = kept.join(numbered, ["lang", "source"]).select(
        "lang", "term", "sid", "n", "all", F.floor(F.col("sid") / block).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), "last")).alias("c"))
    keys = ["lang", "own", "others", "term"]
    dealt = blocks.select("lang", F.least("b", "c").alias("own"), F.greatest("b", "c").alias("others"), "term", "sid", "n", "all").repartitionByRange(*keys)
    found = dealt.sortWithinPartitions(*keys, "sid").mapInArrow(work, _PART)
    summed = found.groupBy("lang", "sid", "part", "other", "term").agg(F.sum("value").alias("value"))
    own, other = (numbered.select("lang", F.col("sid").alias(i), F.col("source").alias(n)) for i, n in (("sid", "source"), ("other", "item")))
    named = summed.join(own, ["lang", "sid"]).join(other, ["lang", "other"], "left").select("lang", "source", "part", F.coalesce("term", "item").alias("item"), "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item"))
    ranked = named.withColumn("rank", rank).filter((F.col("part") == "pair") | (F.col("rank") <= top))
    text = [F.col(c).cast("string").alias(c) for c in ("lang", "source", "part", "item")]
    return ranked.select(*text, "value", "rank")


def _rows(lang: bytes, sid: np.ndarray, part: str, other: np.ndarray | None, term: np.ndarray | None, value: np.ndarray) -> pa.RecordBatch:
    n = len(sid)
    columns = [
        pa.array([lang] * n, pa.binary()), pa.array(sid.astype(np.int32)), pa.array([part] * n, pa.string()),
        pa.nulls(n, pa.int32()) if other is None else pa.array(other.astype(np.int32)),
        pa.nulls(n, pa.binary()) if term is None else pa.array(term.tolist(), pa.binary()), pa.array(value.astype(np.int64)),
    ]
    return pa.RecordBatch.from_arrays(columns, ["lang", "sid", "part", "other", "term", "value"])


def query(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), o AS (
  SELECT rid, lang, source, unnest(w) AS term FROM d
), k AS (
  SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT rid) >= 30
), v AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM k GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY lang, source, term
), s AS (
  SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY lang, source
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(s.total, 0) + 5 * v.v) AS p,
    1 + (1000000000::HUGEINT * (k.n + 5)) // (v.total + 5 * v.v) AS q
  FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang
    LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN s ON s.lang = g.lang AND s.source = g.source
), e AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source
  GROUP BY a.lang, a.source, b.source
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(e.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN e ON e.lang = a.lang AND e.source = a.source AND e.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q
)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r) WHERE part = 'pair' OR rank <= 50"""
