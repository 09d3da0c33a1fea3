"""Queries over streams of the tables, each with the DuckDB SQL of the batch result it must equal."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewell.operators import state
from sievewell.plans.measures import ORACLES as BATCH
from sievewell.plans.measures import APPEALS, WEEK, as_appeals, as_facts, as_updates
from sievewell.sources.tables import table
from sievewell.streaming import keyed, ledger


def shared(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors see."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="sievewell-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def events(spark: SparkSession, path: str, schema, files: int | None = None) -> DataFrame:
    """Event files as a stream, `files` of them a micro-batch."""
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files) if files else reader
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, f"{sf_dir}/events.parque[t]", table(spark, sf_dir, "events").schema)  # as a pattern it may be one file or a folder


def _trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    here = shared(spark, "trailing")
    keyed.run_available(keyed.trailing(as_facts(_events(spark, sf_dir)), WEEK), keyed.numbered_sink(out=(f"{here}/out", "true")), f"{here}/state")
    return spark.read.parquet(f"{here}/out").select("event_id", "count")


def _appeals(spark: SparkSession, sf_dir: str) -> DataFrame:
    here = shared(spark, "appeals")
    good, malformed = state.split_appeals(as_appeals(_events(spark, sf_dir)))
    sink = keyed.numbered_sink(accepted=(f"{here}/accepted", "reason = ''"), rejected=(f"{here}/rejected", "reason <> ''"))
    keyed.run_available(keyed.judged_appeals(good, malformed), sink, f"{here}/state")
    both = spark.read.parquet(f"{here}/accepted").unionByName(spark.read.parquet(f"{here}/rejected"))
    return both.select("appeal_id", "rationale_id", F.timestamp_micros("at").cast("timestamp_ntz").alias("ts"), "reason")


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    here = shared(spark, "ledger")
    book = ledger.Ledger(spark, f"{here}/counts")
    ledger.run_available(as_updates(_events(spark, sf_dir)), ledger.atomic_updates(book), f"{here}/state")
    return book.counts()


QUERIES = {"counter_stream_trailing": _trailing, "appeal_stream": _appeals, "counter_stream_merge": _merged}
ORACLES = {
    "counter_stream_trailing": BATCH["counter_trailing"],
    "appeal_stream": f"""WITH {APPEALS} SELECT appeal_id, rationale_id, ts, CASE WHEN row_number() OVER (PARTITION BY appeal_id ORDER BY ts, rationale_id) = 1 THEN '' ELSE 'duplicate' END AS reason FROM good
      UNION ALL SELECT appeal_id, rationale_id, ts, 'malformed' FROM appeals WHERE NOT (category BETWEEN 0 AND 15 AND severity BETWEEN 0 AND 5 AND user_context <> 'unknown')""",
    "counter_stream_merge": BATCH["counter_batches"],
}
