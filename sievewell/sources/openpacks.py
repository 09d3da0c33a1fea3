"""Documents of open form (rule packs, cases for evaluation, properties of events) as VARIANT: one parse a row, keys read as they are there."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What the checks of a pack read, by key.
PACK = {
    "skill_id": "string",
    "signed_by": "array<string>",
    "overrides": "array<struct<category:int,severity_floor:int>>",
    "rules": "array<struct<category:int,action:string>>",
    "allowed_contexts": "array<string>",
    "lexicons": "array<struct<lexicon_id:string,provenance:string>>",
}
#: Of a case for evaluation: where each column is stated, its type, and what holds where nothing is stated.
CASE = {
    "case_id": (("case_id",), "string", None),
    "language": (("language",), "string", "und"),
    "text": (("message", "text"), "string", ""),
    "language_hint": (("message", "language_hint"), "string", None),
    "quoted": (("message", "quoted_from_user"), "boolean", False),
    "group_kind": (("context", "group_kind"), "string", "small_group"),
    "age_mode": (("context", "group_age_mode"), "string", "adult_only"),
    "user_role": (("context", "user_role"), "string", "member"),
    "relationship_known": (("context", "relationship_known"), "boolean", False),
    "locale": (("context", "locale"), "string", "en-US"),
    "overlay": (("context", "community_overlay_id"), "string", None),
    "is_offline": (("context", "is_offline"), "boolean", False),
    "max_output_tokens": (("constraints", "max_output_tokens"), "int", 600),
    "expected_category": (("expected", "category"), "int", None),
    "expected_severity": (("expected", "severity"), "int", None),
    "severity_at_least": (("expected", "severity_at_least"), "int", None),
    "must_include": (("expected", "reason_codes_must_include"), "array<string>", None),
    "must_exclude": (("expected", "reason_codes_must_exclude"), "array<string>", None),
}


def _path(*keys: str) -> str:
    return "$" + "".join(f"['{k}']" for k in keys)


def has_key(v: Column, *keys: str) -> Column:
    """Whether an object states a key (of a key, ...), be its value null or empty."""
    return F.coalesce(F.try_variant_get(v, _path(*keys), "variant").isNotNull(), F.lit(False))


def _once(rows: DataFrame, kept: list[str], columns: Mapping[str, Column]) -> DataFrame:
    """Rows with columns that are computed once a row: a generator, so that later filters and uses of them do not repeat the parse."""
    return rows.select(*[F.col(f"`{c}`") for c in kept], F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def opened(rows: DataFrame, fields: Mapping[str, str], required: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """Rows with `doc`, the parsed text, a column for each field, and `problem`, the first that holds, or null:

    `not_json` (also a null text), `not_an_object`, `missing_<key>` for a required key that is not there or null, and
    `type_<key>` for a key that is there, not null, and not of its type. Keys without a field are left alone and stay
    in `doc`. Of a row with a problem the fields that can be read are kept. Columns named as a field are replaced.
    """
    doc = F.col("doc")
    left = [c for c in rows.columns if c not in {"doc", "problem", *fields}]
    parsed = _once(rows, left, {"doc": F.try_parse_json(F.col(text))})
    stated = {k: F.try_variant_get(doc, _path(k), kind) for k, kind in fields.items()}
    whole = {k: has_key(doc, k) & ~F.is_variant_null(F.try_variant_get(doc, _path(k), "variant")) for k in {**fields, **dict.fromkeys(required)}}
    problem = F.when(doc.isNull(), "not_json").when(~F.schema_of_variant(doc).startswith("OBJECT"), "not_an_object")
    for k in required:
        problem = problem.when(~whole[k], f"missing_{k}")
    for k in fields:
        problem = problem.when(whole[k] & stated[k].isNull(), f"type_{k}")
    return _once(parsed, [*left, "doc"], {**stated, "problem": problem})


def parted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Opened rows without a problem, and those with one for quarantine."""
    return rows.filter("problem IS NULL").drop("problem"), rows.filter("problem IS NOT NULL")


def pack_rows(rows: DataFrame, text: str = "text") -> DataFrame:
    """Packs from JSON text, in the form that `operators.packs.violations` takes, with `problem`."""
    o = opened(rows, PACK, ("skill_id",), text)
    return o.withColumns({
        "signers": F.col("signed_by"),
        "overrides": F.transform("overrides", lambda x: F.struct(x["category"].alias("category"), x["severity_floor"].alias("floor"))),
        "contexts": F.col("allowed_contexts"),
        "has_taxonomy": has_key(F.col("doc"), "taxonomy"),
        "has_privacy": has_key(F.col("doc"), "privacy_rules"),
        "provenance": F.transform("lexicons", lambda x: x["provenance"]),
        "rule_categories": F.transform("rules", lambda x: x["category"]),
    }).drop("signed_by", "allowed_contexts", "lexicons", "rules")


def case_rows(rows: DataFrame, source: str = "text") -> DataFrame:
    """The columns of CASE and `problem`, from cases as JSON text in the column `source`; other columns are left out.

    Where a key is not stated its default holds; one that is stated as null stays null. A message's language is the
    case's if it states none. A case must be an object and have an id, and its values must be of their types.
    """
    doc = F.col("doc")
    read = {k: F.try_variant_get(doc, _path(*path), kind) for k, (path, kind, _) in CASE.items()}
    wrong = {k: has_key(doc, *path) & ~F.is_variant_null(F.try_variant_get(doc, _path(*path), "variant")) & read[k].isNull() for k, (path, _, _) in CASE.items()}
    problem = F.when(doc.isNull(), "not_json").when(~F.schema_of_variant(doc).startswith("OBJECT"), "not_an_object")
    for k, bad in wrong.items():
        problem = problem.when(bad, f"type_{k}")
    problem = problem.when(read["case_id"].isNull(), "missing_case_id")
    filled = {k: F.when(has_key(doc, *path), read[k]).otherwise(F.lit(default)) for k, (path, _, default) in CASE.items()}
    filled["language_hint"] = F.when(has_key(doc, *CASE["language_hint"][0]), read["language_hint"]).otherwise(filled["language"])
    return _once(_once(rows, [], {"doc": F.try_parse_json(F.col(source))}), [], {**filled, "problem": problem})
