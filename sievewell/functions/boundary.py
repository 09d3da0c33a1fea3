"""What an output must not carry: runs of words copied from an input, and tokens that look like keys or digests. All in the JVM but `echoes`, which hashes runs with numpy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value of the output contract: a run of more words than this is a copy.
MOST_COPIED = 8
#: Tokens long enough to be looked at, and the least bits a character of digests (hexadecimal) and of keys.
TOKEN, LEAST_BITS = "[A-Za-z0-9+/_=-]{20,}", {"hex": 2.5, "key": 3.5}


def _let(value: Column, body) -> Column:
    """`body(value)` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def runs(text: Column, most: int = MOST_COPIED) -> Column:
    """Every run of `most` + 1 words of a text in order, as they stand, joined by single spaces; empty for shorter or null texts."""
    none, size = F.array().cast("array<string>"), most + 1
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x09-\x0D\x20]+"), F.lit(0))
    return _let(words, lambda w: F.when(F.size(w) >= size, F.transform(F.sequence(F.lit(1), F.size(w) - most), lambda i: F.array_join(F.slice(w, i, size), " "))).otherwise(none))


def copies(output: Column, source: Column, most: int = MOST_COPIED) -> Column:
    """Whether an output has a run of more than `most` words of the row's own source.

    The source is closed up to single spaces and searched for the output's runs; without these, as for most short outputs, it is not looked at."""
    closed = F.concat(F.lit(" "), F.regexp_replace(F.coalesce(source, F.lit("")), r"[\x09-\x0D\x20]+", " "), F.lit(" "))
    there = lambda said: _let(closed, lambda s: F.exists(said, lambda run: F.contains(s, F.concat(F.lit(" "), run, F.lit(" ")))))
    return _let(runs(output, most), lambda said: F.when(F.size(said) > 0, there(said)).otherwise(F.lit(False)))


_HEARD, _SAID, _SHARE = 1, 2, 500_000  # roles of a row; runs a bucket shall hold
_STEPS = np.array([pow(0xD6E8FEB86659FD93, i + 1, 1 << 64) for i in range(64)], np.uint64)
_PACKED = "bucket int, a binary, b binary, doc binary, place binary, k binary, at binary, role binary"


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hashed_runs(texts: list[str | None], k: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """a (64 bits), b (32 bits), text and place of every run of `size` words; equal runs of equal k have equal a and b."""
    words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]  # bytes are split at white space of ASCII only
    lens = np.array([len(w) for w in words], np.int64)
    stops = np.cumsum(lens)
    codes, known = pd.factorize(np.array([x for w in words for x in w], object))
    doc = np.repeat(np.arange(len(texts)), lens)
    at = np.flatnonzero(np.arange(len(codes)) + size <= stops[doc])
    doc, both = doc[at], []
    for key in ("sievewell-echo-a", "sievewell-echo-b"):
        each = pd.util.hash_array(known, hash_key=key, categorize=False)[codes] if len(known) else np.zeros(0, np.uint64)
        total = np.zeros(max(0, len(codes) - size + 1), np.uint64)
        for i in range(size):
            total += each[i : i + len(total)] * (_STEPS[i % 64] + np.uint64(2 * (i // 64)))
        both.append(_mixed(_mixed(total)[at] + k.view(np.uint64)[doc]))
    return both[0], (both[1] >> np.uint64(32)).astype(np.uint32), doc, at - (stops - lens)[doc]


def _by_run(a: np.ndarray, b: np.ndarray, at: np.ndarray, heard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of runs by their hashes, and in this order the least time that each run is heard at."""
    order = np.argsort(a, kind="stable")
    x, y = a[order], b[order]
    if ((x[1:] == x[:-1]) & (y[1:] != y[:-1])).any():
        order = np.lexsort((b, a))
        x, y = a[order], b[order]
    first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
    since = np.minimum.reduceat(np.where(heard[order], at[order], np.iinfo(np.int64).max), first)
    return order, np.repeat(since, np.diff(np.append(first, len(a))))


def _slices(texts: list[str | None], limit: int = 4 << 20) -> Iterator[slice]:
    """Slices of about `limit` characters; a longer text is a slice of its own."""
    begin = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t or "") > limit:
            yield slice(begin, i)
            begin, held = i, 0
        held += len(t or "")
    yield slice(begin, len(texts))


def _packer(size: int, bits: int):
    """Rows (k, at, role, text) to rows of a bucket of runs each: those that wait for other rows, and, without hashes, the copies already found."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            every = batch.column("text").to_pylist()
            k, at, role = (batch.column(c).to_numpy() for c in ("k", "at", "role"))
            for part in _slices(every):
                a, b, doc, place = _hashed_runs(every[part], k[part], size)
                if not len(a):
                    continue
                when, what = at[part][doc], role[part][doc]
                order, since = _by_run(a, b, when, what & _HEARD > 0)
                a, b, doc, place, when, what = (x[order] for x in (a, b, doc, place, when, what))
                found = (what & _SAID > 0) & (since < when)
                waits = ~found & ((what & _SAID > 0) | (when == since))
                rows, n = [], n + 1

                def row(bucket: int, pick: np.ndarray, hashed: bool) -> list:
                    docs, which = np.unique(doc[pick], return_inverse=True)
                    hashes = [a[pick], b[pick]] if hashed else [a[:0], b[:0]]
                    columns = [*hashes, which.astype(np.uint32 if len(docs) > 65535 else np.uint16), place[pick].astype(np.uint32), k[part][docs], at[part][docs], role[part][docs].astype(np.uint8)]  # noqa: B023
                    return [bucket, *[c.tobytes() for c in columns]]

                if found.any():
                    rows.append(row(n * 7919 % (1 << bits), np.flatnonzero(found), False))
                open_ = np.flatnonzero(waits)
                ends = np.searchsorted(a[open_] >> np.uint64(64 - bits) if bits else np.zeros(len(open_), np.uint64), np.arange((1 << bits) + 1, dtype=np.uint64))
                rows += [row(i, open_[x:y], True) for i, (x, y) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if x < y]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(zip(*rows, strict=True))], [f.split()[0] for f in _PACKED.split(", ")])

    return pack


def _settled(bucket: pa.Table) -> pa.Table:
    """k, at and place of the runs of a bucket that an earlier row has."""
    rows = []
    for r in bucket.to_pylist():
        k, at, role = (np.frombuffer(r[c], t) for c, t in (("k", np.int64), ("at", np.int64), ("role", np.uint8)))
        doc = np.frombuffer(r["doc"], np.uint32 if len(k) > 65535 else np.uint16)
        a, b = np.frombuffer(r["a"], np.uint64), np.frombuffer(r["b"], np.uint32)
        rows.append((a, b, k[doc], at[doc], role[doc], np.frombuffer(r["place"], np.uint32).astype(np.int32), np.full(len(doc), len(a) > 0)))
    waits = np.concatenate([r[6] for r in rows])
    a, b, k, at, role, place = (np.concatenate([r[i] for r in rows]) for i in range(6))
    found = ~waits
    if len(a):
        order, since = _by_run(a, b, at[waits], role[waits] & _HEARD > 0)
        open_ = np.flatnonzero(waits)[order]
        found[open_] = (role[open_] & _SAID > 0) & (since < at[open_])
    return pa.table({"k": k[found], "at": at[found], "place": place[found]})


def echoes(outputs: DataFrame, inputs: DataFrame, keys: list[str], at: str, text: str = "text", most: int = MOST_COPIED) -> DataFrame:
    """keys, at, copied and first: of each output with a run of more than `most` words of any earlier input of its keys, how many runs it copies, and the place of the first.

    A run meets inputs by 96 bits of hashes. Runs leave a task in arrays, a row for each of the buckets that their hashes
    are dealt to, which are so many that none holds more than about _SHARE runs; what a task knows to be copied by its own
    rows leaves without hashes, and of a run heard in many rows of a task the earliest alone. Each text is read once,
    also where outputs and inputs are the same DataFrame. Rows of a null key or time echo nothing; rows of equal keys and
    time are one output. Times are whole numbers, dates or timestamps.
    """
    kind = outputs.schema[at].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long", "date", "timestamp", "timestamp_ntz"):
        raise TypeError(f"{at} must be a whole number, a date or a timestamp, not {kind}")
    time = F.unix_micros(F.col(at).cast("timestamp")) if kind.startswith("timestamp") else F.unix_date(at).cast("long") if kind == "date" else F.col(at).cast("long")
    key, there = F.xxhash64(*[F.col(c) for c in keys]), reduce(and_, [F.col(c).isNotNull() for c in [*keys, at]])
    rows = lambda df, role: df.filter(there).select(key.alias("k"), time.alias("at"), F.lit(role).alias("role"), F.col(text).alias("text"))
    every = rows(outputs, _HEARD | _SAID) if outputs is inputs else rows(outputs, _SAID).unionByName(rows(inputs, _HEARD))
    chars = every.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = max(0, int(chars / 6 / _SHARE).bit_length())
    met = every.mapInArrow(_packer(most + 1, bits), _PACKED).groupBy("bucket").applyInArrow(_settled, "k long, at long, place int")
    counted = met.repartition("k", "at").distinct().groupBy(F.col("k").alias("_k"), F.col("at").alias("_time")).agg(F.count(F.lit(1)).alias("copied"), (F.min("place") + 1).alias("first"))
    named = outputs.filter(there).select(key.alias("_k"), time.alias("_time"), *keys, at).dropDuplicates(["_k", "_time"])
    return named.join(counted, ["_k", "_time"]).select(*keys, at, "copied", "first")


def entropy(token: Column) -> Column:
    """Bits a character of a token, from the counts of its characters; 0 for an empty one, null for null."""
    n = F.length(token)
    logs = F.aggregate(F.transform(F.array_distinct(F.split(token, "")), lambda c: (n - F.length(F.replace(token, c, F.lit("")))).cast("double")), F.lit(0.0), lambda t, k: t + k * F.log2(k))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.log2(n.cast("double")) - logs / n)


def blobs(text: Column) -> Column:
    """Array of (place, kind, length, bits): the tokens of a text that look like digests (`hex`) or keys (`key`: letters and digits), by their place among its long tokens."""
    def one(t: Column, i: Column) -> Column:
        kind = F.when(t.rlike("^[0-9a-fA-F]{24,}$"), "hex").when(t.rlike("[0-9]") & t.rlike("[A-Za-z]"), "key")
        return F.struct((i + 1).alias("place"), kind.alias("kind"), F.length(t).alias("length"), F.round(entropy(t), 6).alias("bits"))

    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), one)
    return F.filter(found, lambda b: ((b["kind"] == "hex") & (b["bits"] >= LEAST_BITS["hex"])) | ((b["kind"] == "key") & (b["bits"] >= LEAST_BITS["key"])))
