"""An exactly-once counter table: micro-batches are merged under their number, and only what is committed is read.

A micro-batch writes its sums by key to `delta/batch=N` and then commits by creating the empty
file `commits/N`, or `commits/N.snapshot` if it wrote all sums up to it besides. A batch that
failed before its commit is invisible, and its retry writes over what it left; a batch whose
commit is there changes nothing. Every `compact_every` commits a snapshot is written, and
readers take the newest snapshot and the deltas after it; `keep_since` leaves old slices out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewell.operators.state import valid_updates


@dataclass(frozen=True)
class Ledger:
    spark: SparkSession
    path: str
    keys: tuple[str, ...] = ("group_id", "counter_id")
    compact_every: int = 20
    keep: Column | None = None

    def _fs(self, path: str):
        there = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return there.getFileSystem(self.spark._jsc.hadoopConfiguration()), there

    def commits(self) -> dict[int, bool]:
        """The committed batches, and whether each has a snapshot. A file a batch; those before the last snapshot are needed no more."""
        fs, folder = self._fs(f"{self.path}/commits")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return {int(n.removesuffix(".snapshot")): n.endswith(".snapshot") for n in names}

    def commit(self, number: int, snapshot: bool) -> None:
        fs, there = self._fs(f"{self.path}/commits/{number}{'.snapshot' * snapshot}")
        fs.create(there, False).close()

    def counts(self) -> DataFrame | None:
        """keys and count as committed; None before the first commit."""
        done = self.commits()
        if not done:
            return None
        base = max((n for n, snapshot in done.items() if snapshot), default=-1)
        paths = [f"{self.path}/snapshot/batch={base}"] * (base >= 0) + [f"{self.path}/delta/batch={n}" for n in sorted(done) if n > base]
        return self.spark.read.parquet(*paths).groupBy(*self.keys).agg(F.sum("count").alias("count"))

    def merge(self, updates: DataFrame, number: int) -> None:
        """Adds the deltas of `updates`, which may have been tried before."""
        done = self.commits()
        if number in done:
            return
        summed = updates.groupBy(*self.keys).agg(F.sum("delta").alias("count"))
        summed.write.mode("overwrite").parquet(f"{self.path}/delta/batch={number}")
        last = max((n for n, snapshot in done.items() if snapshot), default=-1)
        snapshot = sum(n > last for n in done) + 1 >= self.compact_every
        if snapshot:
            whole = self.spark.read.parquet(f"{self.path}/delta/batch={number}")
            if done:
                whole = whole.unionByName(self.counts()).groupBy(*self.keys).agg(F.sum("count").alias("count"))
            whole = whole.filter(self.keep) if self.keep is not None else whole
            whole.write.mode("overwrite").parquet(f"{self.path}/snapshot/batch={number}")
        self.commit(number, snapshot)

    def vacuum(self) -> None:
        """Deletes what is before the newest snapshot, commits last."""
        done = self.commits()
        base = max((n for n, snapshot in done.items() if snapshot), default=-1)
        for n in sorted(n for n in done if n < base):
            for path in (f"delta/batch={n}", f"snapshot/batch={n}", f"commits/{n}{'.snapshot' * done[n]}"):
                fs, there = self._fs(f"{self.path}/{path}")
                fs.delete(there, True)


def atomic_updates(ledger: Ledger) -> Callable[[DataFrame, int], None]:
    """A sink for streams of (batch_id, group_id, counter_id, delta): an invalid update rejects its whole batch, which must be within one micro-batch."""
    return lambda batch, number: ledger.merge(valid_updates(batch), number)


def run_available(updates: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    query = updates.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(sink).start()
    query.awaitTermination()
