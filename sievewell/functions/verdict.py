"""From signals to verdicts: one ordered choice of rule, then one ordered threshold policy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the output contract.
LABEL_ONLY, WARN, STRONG_WARN, CRITICAL = 0.45, 0.62, 0.78, 0.85
SAFE, CHILD_SAFETY, SCAM_FRAUD, PRIVATE_DATA, SEXUAL_ADULT = 0, 1, 7, 9, 10
ACTIONS = ("label_only", "warn", "strong_warn", "critical_intervention", "suggest_redact")
PROTECTED = ("QUOTED_SPEECH_CONTEXT", "NEWS_CONTEXT", "EDUCATION_CONTEXT", "COUNTERSPEECH_CONTEXT")
CODES = ("LEXICON_HIT", "SCAM_PATTERN", "PRIVATE_DATA_PATTERN", "URL_RISK", *PROTECTED, "GROUP_AGE_MODE", "JURISDICTION_OVERRIDE", "COMMUNITY_RULE", "CHILD_SAFETY_FLOOR")
HEALTH = {"healthy": "healthy", "model_unavailable": "model_unavailable", "tokenizer_unavailable": "model_unavailable", "dependency_missing": "model_unavailable", "inference_error": "inference_error"}
TAXONOMY = ("SAFE", "CHILD_SAFETY", "SELF_HARM", "VIOLENCE_THREAT", "EXTREMISM", "HARASSMENT", "HATE", "SCAM_FRAUD", "MALWARE_LINK", "PRIVATE_DATA", "SEXUAL_ADULT", "DRUGS_WEAPONS", "ILLEGAL_GOODS", "MISINFORMATION_HEALTH", "MISINFORMATION_CIVIC", "COMMUNITY_RULE")
DEGRADED = "model_unavailable_rule_only_v1"

_NONE = lambda: F.array().cast("array<string>")


def actions(*on: str, redact: Column | None = None) -> Column:
    return F.struct(*[(redact if a == "suggest_redact" and redact is not None else F.lit(a in on)).alias(a) for a in ACTIONS])


def _verdict(category: Column | int, severity: Column | int, confidence: Column | float, acts: Column, codes: Column, rationale: Column | str, resource: Column | str | None = None) -> Column:
    lit = lambda x, kind: (x if isinstance(x, Column) else F.lit(x)).cast(kind)
    return F.struct(lit(category, "int").alias("category"), lit(severity, "int").alias("severity"), lit(confidence, "double").alias("confidence"), acts.alias("actions"), codes.alias("reason_codes"), lit(rationale, "string").alias("rationale_id"), lit(resource, "string").alias("resource_link_id"))


def raw_verdict(url_risk: Column, pii: Column, scam: Column, lexicon: Column, nsfw: Column, hints: Column) -> Column:
    """The first rule that holds: child-safety word, personal data, scam, other word, media, safe.

    `lexicon`: array of (lexicon_id, category, weight) in order; `nsfw`: the first score over 0.7, or
    null; `hints`: array of (code, confidence).
    """
    d = F.lit
    child = F.filter(lexicon, lambda h: h["category"] == CHILD_SAFETY)
    top = F.array_max(F.transform(lexicon, lambda h, i: F.struct(h["weight"].alias("weight"), (-i).alias("first"), h["category"].alias("category"))))
    some = lambda *pairs: F.filter(F.array(*[F.when(c, d(x)) for x, c in pairs]), lambda x: x.isNotNull())
    child_weight = F.array_max(F.transform(child, lambda h: h["weight"]))
    scammy = (url_risk > d(0.8)) | (F.size(scam) > 0)
    by_count = lambda n: d(0.55) + d(0.1) * F.size(n)
    return (
        F.when(F.size(child) > 0, _verdict(CHILD_SAFETY, 5, F.greatest(d(0.45), F.least(d(0.99), child_weight)), actions("critical_intervention"), F.array(d("LEXICON_HIT"), d("CHILD_SAFETY_FLOOR")), "child_safety_floor_v1", "child_safety_resources_v1"))
        .when(F.size(pii) > 0, _verdict(PRIVATE_DATA, 3, F.least(d(0.95), by_count(pii)), actions("warn", "suggest_redact"), F.array(d("PRIVATE_DATA_PATTERN")), "private_data_pii_v1"))
        .when(scammy, _verdict(SCAM_FRAUD, 3, F.least(d(0.95), F.greatest(url_risk, F.when(F.size(scam) > 0, by_count(scam)).otherwise(d(0.55)))), actions("warn"), some(("URL_RISK", url_risk > d(0.8)), ("SCAM_PATTERN", F.size(scam) > 0)), "scam_credential_phish_v1"))
        .when((F.size(lexicon) > 0) & (top["category"] != SAFE), _verdict(top["category"], 3, F.greatest(d(0.45), F.least(d(0.95), top["weight"])), actions("warn"), F.array(d("LEXICON_HIT")), F.concat(d("lexicon_category_"), top["category"].cast("string"), d("_v1"))))
        .when((F.size(lexicon) == 0) & nsfw.isNotNull(), _verdict(SEXUAL_ADULT, 3, F.least(d(0.95), nsfw), actions("warn"), _NONE(), "sexual_adult_media_v1"))
        .otherwise(_verdict(SAFE, 0, 0.05, actions(), F.transform(hints, lambda h: h["code"]), "safe_benign_v1"))
    )


def degraded_verdict(health: Column, url_risk: Column, pii: Column, scam: Column, lexicon: Column, codes_given: Column | None = None, rationale: Column | None = None) -> Column:
    """What is left without a model: SAFE, with the scorer's codes and rationale, if it gave any, and then the detectors' codes, each once. Null for a healthy model."""
    given = F.coalesce(codes_given, _NONE()) if codes_given is not None else _NONE()
    why = F.coalesce(F.nullif(rationale, F.lit("")), F.lit(DEGRADED)) if rationale is not None else DEGRADED
    codes = F.array(*[F.when(c, F.lit(x)) for x, c in (("PRIVATE_DATA_PATTERN", F.size(pii) > 0), ("SCAM_PATTERN", F.size(scam) > 0), ("URL_RISK", url_risk >= F.lit(0.5)), ("LEXICON_HIT", F.size(lexicon) > 0))])
    return F.when(health != "healthy", _verdict(SAFE, 0, 0.0, actions(), F.array_distinct(F.filter(F.concat(given, codes), lambda x: x.isNotNull() & (x != ""))), why))


def model_health(health: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in HEALTH.items() for x in kv])
    return F.coalesce(F.try_element_at(table, health), F.lit("model_unavailable"))


def coerced(category: Column, severity: Column, confidence: Column, codes: Column) -> Column:
    """A verdict of a foreign scorer brought to the contract; out of range it becomes an inference error."""
    c, s, p = category.try_cast("int"), severity.try_cast("int"), confidence.try_cast("double")
    good = c.between(0, 15) & s.between(0, 5) & p.between(0.0, 1.0)
    known = F.array_distinct(F.filter(F.coalesce(codes, _NONE()), lambda x: x.isin(*CODES)))
    fine = F.struct(c.alias("category"), s.alias("severity"), p.alias("confidence"), known.alias("reason_codes"), F.lit("healthy").alias("model_health"))
    bad = F.struct(F.lit(0).alias("category"), F.lit(0).alias("severity"), F.lit(0.0).alias("confidence"), _NONE().alias("reason_codes"), F.lit("inference_error").alias("model_health"))
    return F.when(F.coalesce(good, F.lit(False)), fine).otherwise(bad)


def tier(confidence: Column) -> Column:
    """The one action of a confidence; null below the least threshold."""
    steps = ((CRITICAL, "critical_intervention"), (STRONG_WARN, "strong_warn"), (WARN, "warn"), (LABEL_ONLY, "label_only"))
    out = F.when(confidence >= F.lit(steps[0][0]), F.lit(steps[0][1]))
    for least, action in steps[1:]:
        out = out.when(confidence >= F.lit(least), F.lit(action))
    return out


def sorted_codes(codes: Column) -> Column:
    return F.array_sort(F.array_distinct(codes))


def best_hint(codes: Column, confidences: Column | None) -> Column:
    """The highest confidence of the protected codes; 1 without a map of confidences, 0 for a code it lacks."""
    own = F.filter(codes, lambda c: c.isin(*PROTECTED))
    if confidences is None:
        return F.lit(1.0)
    found = F.array_max(F.transform(own, lambda c: F.coalesce(F.try_element_at(confidences, c), F.lit(0.0))))
    return F.when(confidences.isNull(), F.lit(1.0)).otherwise(F.coalesce(found, F.lit(0.0)))


def policy_verdict(v: Column, confidences: Column | None = None, strong: float = 0.5) -> Column:
    """The threshold policy on a raw verdict: child safety, protected speech, thresholds, in this order."""
    category, confidence, codes = v["category"], v["confidence"], F.coalesce(v["reason_codes"], _NONE())
    protected = F.filter(codes, lambda c: c.isin(*PROTECTED))
    best, redact = best_hint(codes, confidences), v["actions"]["suggest_redact"]
    step = tier(confidence)
    tiered = F.struct(*[(redact if a == "suggest_redact" else (step == a)).alias(a) for a in ACTIONS])
    shielded = (category != SAFE) & (F.size(protected) > 0)
    return (
        F.when((category == CHILD_SAFETY) & (confidence >= F.lit(LABEL_ONLY)), _verdict(category, 5, confidence, actions("critical_intervention"), sorted_codes(F.array_append(codes, F.lit("CHILD_SAFETY_FLOOR"))), v["rationale_id"], v["resource_link_id"]))
        .when(shielded & (best >= F.lit(strong)), _verdict(SAFE, 0, confidence, actions(), sorted_codes(protected), "safe_protected_speech_v1"))
        .when(shielded, _verdict(category, F.least(v["severity"], F.lit(2)), confidence, actions("warn", redact=redact), sorted_codes(F.array_append(codes, F.lit("WARN_WITH_CONTEXT"))), "warn_low_confidence_context_v1"))
        .when((category != SAFE) & (confidence < F.lit(LABEL_ONLY)), _verdict(SAFE, 0, confidence, actions(), _NONE(), F.coalesce(v["rationale_id"], F.lit("safe_benign_v1"))))
        .when(category != SAFE, _verdict(category, v["severity"], confidence, tiered, codes, v["rationale_id"], v["resource_link_id"]))
        .otherwise(v)
    )


def flagged(v: Column) -> Column:
    return (v["category"] != SAFE) | v["actions"]["label_only"] | v["actions"]["warn"] | v["actions"]["strong_warn"] | v["actions"]["critical_intervention"]


def action_name(v: Column, names: Sequence[str] = ACTIONS) -> Column:
    """The names of the actions that are on, joined by +."""
    return F.array_join(F.filter(F.array(*[F.when(v["actions"][a], F.lit(a)) for a in names]), lambda x: x.isNotNull()), "+")
