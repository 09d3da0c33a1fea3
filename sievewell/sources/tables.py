"""Where rows come from: the star-schema tables, screened messages, and small files of rule packs and cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Endings that give messages links, personal data and scam phrasing, by id modulo 8.
SALT = (" wire it today for a small fee", " congratulations you have won", " confirm now with your password", " see http://files.example.zip/a", " at www.login-portal.example", " mail jo@example.org or +1 202-555-0143", " zzchildterm", "")
OVERLAYS = ("city_news", "school_education", "civic_forum", None, "workplace")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _by(key: Column, values: tuple) -> Column:
    out = F.lit(None).cast("string")
    for i, v in enumerate(values):
        out = F.when(key == i, F.lit(v)).otherwise(out)
    return out


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as messages: msg_id, text, lang, group_id, overlay, quoted and nsfw."""
    d = table(spark, sf_dir, "documents")
    nsfw = F.when(F.col("doc_id") % 11 == 0, F.lit(0.9)).when(F.col("doc_id") % 11 == 1, F.lit(0.6))
    return d.select(
        F.col("doc_id").alias("msg_id"), F.concat(F.col("text"), _by(F.col("doc_id") % 8, SALT)).alias("text"), "lang", F.col("source").alias("group_id"),
        _by(F.col("doc_id") % 5, OVERLAYS).alias("overlay"), (F.col("doc_id") % 7 == 0).alias("quoted"), nsfw.alias("nsfw"))


def event_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with `ts` as an instant; files hold it without a time zone."""
    e = table(spark, sf_dir, "events")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def packs_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rule packs or revocation lists from JSON files; rows that do not parse are dropped by the caller's schema check."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_text(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").text(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path and SHA-256 of files, for checking artefacts against a manifest."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def require(df: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """Rows in which every required key is set, and the rest for quarantine."""
    good = F.lit(True)
    for k in keys:
        good = good & F.col(k).isNotNull()
    return df.filter(good), df.filter(~good)
