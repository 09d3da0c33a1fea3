"""What the operators of this package share: tables, words, and tables written to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from weakref import WeakKeyDictionary

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but space, \t, \n, \v, \f and \r.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
BLANKS = r"\x20\x09-\x0D"
BITS = 1 << 28  # of a filter, at most


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=8)
def _own_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="sievewell-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master, where both are one process, may leave it unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = _own_dir(spark.sparkContext.applicationId)
    return folder.rstrip("/")


def small_batches(rows: int = 1000, size: int = 16 << 20) -> None:
    """Keeps what a task hands to Python at a time to `rows` rows and about `size` bytes, as documents can be long.

    These are settings of the session, read when a result is computed, and so they stay set."""
    conf = SparkSession.active().conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        if not 0 < int(str(conf.get(key)).rstrip("bB")) <= most:
            conf.set(key, str(most))


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_scopes: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes at its end what `written` made within, so nothing that is left may read it; `written(..., stays=True)` is not of it."""
    _scopes.append([])
    try:
        yield
    finally:
        forget(*_scopes.pop())


def written(df: DataFrame, name: str, stays: bool = False) -> DataFrame:
    """`df` as a Parquet table in the shared folder: computed once, and read again after a lost executor.

    Its shuffle files are deleted as soon as it is written; `forget` deletes the table itself, and so does the end of a `scratch`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sievewell/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.select("*").write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before) if before is not None else spark.conf.unset(_CLEAN)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    if _scopes and not stays:
        _scopes[-1].append(out)
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables that `written` made, of which nothing is left to compute."""
    for t in tables:
        if path := _paths.pop(t, None):
            there = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(there, True)


def bit_filter(values: DataFrame) -> np.ndarray:
    """A filter of fixed size for the longs of a column: one bit each, of BITS bits at most. Its words are all that reaches the driver."""
    name = values.columns[0]
    bits = min(BITS, 1 << max(16, (16 * values.count()).bit_length()))
    at = F.pmod(F.col(name), F.lit(bits))
    words = values.select(F.shiftright(at, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(`{name}`, 64) as int))").alias("b"))
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[got["w"].to_numpy()] = got["b"].to_numpy()
    return out.view(np.uint64)


def held_by(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values a filter may hold."""
    at = values.astype(np.int64).view(np.uint64) & np.uint64(64 * len(bits) - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def bind(value: Column, body) -> Column:
    """`body(value)` with `value` computed once per row, however often `body` names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def chars_of(text: Column, chars: str) -> Column:
    """How many characters of `text` are in the character class `chars`."""
    return F.regexp_count(text, F.lit(f"[{chars}]")).cast("long")
