"""Chat formatting: logged snapshots of a conversation are collapsed to the longest, which is rendered.

A conversation's turns, in order, give a rolling hash of each prefix: two 64-bit sums, by
exclusive or, of position, role and text. A conversation is a snapshot of another if its own hash is
that of a shorter prefix of the other; of equal conversations the least id stays. Only the
distinct hashes of prefixes meet in the anti-join, never the conversations that share one.

Cases: null turns come first, then by turn, role and text; repeated rows are repeated turns;
a null role is rendered and compared as `unknown`, a null text as an empty one; rows with a
null conv_id are one conversation of id null; an empty table gives none; other columns are
ignored. A conversation is one row of the result, and so is held by one task at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievewell.llm.common import table, written

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, i, n and the rolling hash (a, b) of each conversation's first i of n turns."""
    own = turns.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    by_turn = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = own.withColumn("i", F.row_number().over(by_turn))
    upto = by_turn.rowsBetween(Window.unboundedPreceding, 0)
    rolling = [F.bit_xor(F.xxhash64(F.lit(s), "i", "role", "text")).over(upto).alias(s) for s in "ab"]
    return numbered.select("conv_id", "i", F.count(F.lit(1)).over(Window.partitionBy("conv_id")).cast("int").alias("n"), *rolling)


def maximal(turns: DataFrame) -> DataFrame:
    """The conv_id of each conversation that no longer one begins with, one of each set of equals."""
    seen = written(prefixes(turns), "chat-prefixes")
    shorter = seen.filter("i < n").select("a", "b", F.col("i").alias("n")).distinct()
    least = F.min(F.struct(F.col("conv_id").isNull().alias("last"), "conv_id")).alias("least")
    first = seen.filter("i = n").groupBy("a", "b", "n").agg(least)
    return first.join(shorter, ["a", "b", "n"], "left_anti").select("least.conv_id")


def rendered(turns: Column) -> Column:
    """Each turn between its marks; marks in a role or text are broken by a space and line ends of a role become spaces, so that neither opens or closes a turn."""

    def one(t: Column) -> Column:
        plain = lambda c: F.regexp_replace(c, r"<\|(im_start|im_end)\|>", "< |$1|>")
        role = F.regexp_replace(plain(t["role"]), r"[\r\n]", " ")
        return F.concat(F.lit(OPEN), role, F.lit("\n"), plain(t["text"]), F.lit(CLOSE), F.lit("\n"))

    return F.array_join(F.transform(turns, one), "")


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns and text of each maximal conversation."""
    stay = maximal(turns)
    kept = turns.join(stay, turns["conv_id"].eqNullSafe(stay["conv_id"]), "left_semi")
    turn = F.struct("turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = kept.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return whole.select("conv_id", F.size("turns").cast("long").alias("n_turns"), rendered(F.col("turns")).alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    return formatted(table(spark, sf_dir, "conversations"))


ORACLE = rf"""
WITH c AS (
  SELECT conv_id, list({{'role': coalesce(role, 'unknown'), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS turns
  FROM conversations GROUP BY conv_id
), p AS (
  SELECT DISTINCT turns[1:n] AS turns FROM (SELECT turns, unnest(range(1, len(turns))) AS n FROM c)
), f AS (
  SELECT turns, arg_min(conv_id, conv_id) AS conv_id FROM c GROUP BY turns
)
SELECT conv_id, len(turns)::BIGINT AS n_turns,
  array_to_string(list_transform(turns, lambda t: '{OPEN}' || regexp_replace(regexp_replace(t.role, '<\|(im_start|im_end)\|>', '< |\1|>', 'g'), '[\r\n]', ' ', 'g') || chr(10) || regexp_replace(t.text, '<\|(im_start|im_end)\|>', '< |\1|>', 'g') || '{CLOSE}' || chr(10)), '') AS text
FROM f WHERE turns NOT IN (SELECT turns FROM p)"""
