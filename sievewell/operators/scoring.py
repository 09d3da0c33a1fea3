"""Scorers of any make behind one contract: their rows are brought to it, failures stay with their rows, and health goes with every verdict.

A scorer is a function of a DataFrame to the same rows with a column `scored`, of the type SCORED. Numbers are text in it,
as a foreign scorer may state anything. A null `scored` counts as a failure of that row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewell.functions import boundary, verdict

SCORED = "category string, severity string, confidence string, actions array<string>, reason_codes array<string>, rationale_id string, resource_link_id string, model_health string, counter_updates array<struct<counter_id:string,delta:bigint>>"
Scorer = Callable[[DataFrame], DataFrame]
_TEXTS = ("category", "severity", "confidence", "rationale_id", "resource_link_id", "model_health")


def _plain(given: dict) -> dict:
    """One answer of a function in the types of SCORED; what has no such form raises."""
    out = {k: None if given.get(k) is None else str(given[k]) for k in _TEXTS}
    for k in ("actions", "reason_codes"):
        out[k] = [x for x in given.get(k) or [] if isinstance(x, str)]
    out["counter_updates"] = [{"counter_id": u.get("counter_id"), "delta": None if u.get("delta") is None else int(u["delta"])} for u in given.get("counter_updates") or []]
    return out


def _answers(fn: Callable[[list[dict]], list[dict]], rows: list[dict]) -> list[dict]:
    """Answers to all rows: a batch that fails, or is answered with another number of rows, is halved until the failure is alone."""
    try:
        got = [_plain(a) for a in fn(rows)]
        if len(got) != len(rows):
            raise ValueError(f"{len(got)} answers to {len(rows)} rows")
        return got
    except Exception:  # whatever a foreign function raises stays with its row
        if len(rows) == 1:
            return [_plain({"model_health": "inference_error"})]
        half = len(rows) // 2
        return _answers(fn, rows[:half]) + _answers(fn, rows[half:])


def of_function(fn: Callable[[list[dict]], list[dict]], inputs: Sequence[str]) -> Scorer:
    """A scorer from a function of a list of rows, as dicts of the columns `inputs`, to as many answers. Only these columns go to Python."""
    names = list(inputs)

    @F.pandas_udf(SCORED)
    def score(rows: pd.DataFrame) -> pd.DataFrame:
        columns = [list(rows[n]) for n in names]
        given = [dict(zip(names, values, strict=True)) for values in zip(*columns, strict=True)]
        return pd.DataFrame(_answers(fn, given) if given else [], columns=[*_TEXTS[:3], "actions", "reason_codes", *_TEXTS[3:], "counter_updates"])

    return lambda df: df.withColumn("scored", score(F.struct(*names)))


def classified(signals: DataFrame, scorer: Scorer, confidences: Column | None = None, text: str = "text") -> DataFrame:
    """Messages with `verdict`, `model_health` and `counter_updates`; none is lost, and no text leaves.

    `signals` are as `screen.signals` gives them: url_risk, pii, scam, lex, and the text, which is held against what the
    scorer says. An answer out of range is an inference error; so is one whose rationale or link copies more than eight words
    of the text or carries a token like a key. An unhealthy scorer's verdict keeps what it stated, if that is in range, and the codes of
    the detectors are added. Updates of counters are kept where the policy keeps the scorer's verdict, and not where it
    puts another in its place.
    """
    s = F.col("scored")
    told = F.concat_ws(" ", s["rationale_id"], s["resource_link_id"])
    leaks = F.coalesce(boundary.copies(told, F.col(text)), F.lit(False)) | (F.size(boundary.blobs(told)) > 0)
    checked = scorer(signals).withColumns({"_fit": verdict.coerced(s["category"], s["severity"], s["confidence"], s["reason_codes"]), "_leaks": leaks})
    fit, stated = F.col("_fit"), F.coalesce(s["model_health"], F.lit("healthy"))
    health = F.when(stated.isNotNull() & ~stated.isin("healthy", ""), verdict.model_health(stated)).when(F.col("_leaks"), "inference_error").otherwise(fit["model_health"])
    fine = (fit["model_health"] == "healthy") & ~F.col("_leaks")
    rationale = F.when(~F.col("_leaks"), F.nullif(s["rationale_id"], F.lit("")))
    link = F.when(~F.col("_leaks"), s["resource_link_id"])
    ready = checked.withColumns({"_health": health, "_fine": fine, "_rationale": rationale, "_link": link})
    weak = verdict.degraded_verdict(F.col("_health"), F.col("url_risk"), F.col("pii"), F.col("scam"), F.col("lex"), fit["reason_codes"])
    codes = F.coalesce(weak["reason_codes"], fit["reason_codes"])
    why = F.coalesce(F.col("_rationale"), F.when(F.col("_health") != "healthy", verdict.DEGRADED).otherwise("safe_benign_v1"))
    acts = F.struct(*[F.array_contains(F.coalesce(F.when(F.col("_fine"), s["actions"]), F.array().cast("array<string>")), a).alias(a) for a in verdict.ACTIONS])
    number = lambda k, kind: F.when(F.col("_fine"), fit[k]).otherwise(F.lit(0)).cast(kind).alias(k)
    raw = F.struct(number("category", "int"), number("severity", "int"), number("confidence", "double"), acts.alias("actions"), codes.alias("reason_codes"), why.alias("rationale_id"), F.col("_link").alias("resource_link_id"))
    kept = [F.col(f"`{c}`") for c in signals.columns if c not in (text, "norm", "scored", "verdict", "model_health", "counter_updates")]
    ruled = ready.select(*kept, raw.alias("_raw"), F.col("_health").alias("model_health"), F.coalesce(s["counter_updates"], F.array().cast("array<struct<counter_id:string,delta:bigint>>")).alias("_updates"))
    r = F.col("_raw")
    child = (r["category"] == verdict.CHILD_SAFETY) & (r["confidence"] >= F.lit(verdict.LABEL_ONLY))
    shielded = F.exists(r["reason_codes"], lambda c: c.isin(*verdict.PROTECTED))
    replaced = (r["category"] != verdict.SAFE) & ~child & (shielded | (r["confidence"] < F.lit(verdict.LABEL_ONLY)))
    return ruled.select(*kept, verdict.policy_verdict(r, confidences).alias("verdict"), "model_health", F.when(replaced, F.array().cast("array<struct<counter_id:string,delta:bigint>>")).otherwise(F.col("_updates")).alias("counter_updates"))


def counter_rows(rows: DataFrame, batch: str, group: str) -> DataFrame:
    """Updates as rows of (batch_id, group_id, counter_id, delta), for `state.valid_updates` and the counters. Rows without a group have none."""
    return rows.filter(F.col(group).isNotNull()).select(F.col(batch).alias("batch_id"), F.col(group).alias("group_id"), F.inline("counter_updates"))
