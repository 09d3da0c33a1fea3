"""Policy manifests set from rule packs: six sections of text for each bundle of a baseline, a jurisdiction and a community; each in its row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewell.functions.text import estimate_tokens
from sievewell.functions.verdict import TAXONOMY
from sievewell.operators.packs import TOKEN_BUDGET

# Fixed values of the format.
WIDTH, INDENT = 60, 18
BASELINE = "taxonomy: 16-category v1\nseverity: 0..5 v1\nprivacy_rules: v1 (immutable)\noutput_schema: guardrail.output.v1\nthresholds: label_only=0.45 warn=0.62 strong_warn=0.78 critical=0.85"
INPUT, OUTPUT = "<structured input contract instance>", "<JSON conforming to guardrail.output.v1>"
#: What a manifest reads of a pack, for `openpacks.opened`.
FIELDS = {
    "skill_id": "string",
    "overrides": "array<struct<category:int,severity_floor:int>>",
    "allowed_contexts": "array<string>",
    "community_profile": "struct<age_mode:string>",
    "rules": "array<struct<category:int,action:string,suggest_redact:boolean,suggest_mute:boolean>>",
    "group_risk_counters": "array<struct<counter_id:string,thresholds:struct<label_at:string,strong_label_at:string,escalate_at:string>>>",
}


def wrapped(items: Column, width: int = WIDTH, indent: int = INDENT) -> Column:
    """Items joined by ", ", with a line end, and spaces, before each that would make its line longer than `width`; a longer item has its own line. Null items are left out."""
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"))

    def step(at: Column, item: Column) -> Column:
        longer = F.concat(at["line"], F.lit(", "), item)
        first, full = at["line"] == "", F.length(longer) > width
        lines = F.when(~first & full, F.array_append(at["lines"], F.concat(at["line"], F.lit(",")))).otherwise(at["lines"])
        return F.struct(lines.alias("lines"), F.when(first | full, item).otherwise(longer).alias("line"))

    return F.aggregate(F.array_compact(items), start, step, lambda at: F.array_join(F.array_append(at["lines"], at["line"]), "\n" + " " * indent))


def _category(c: Column) -> Column:
    names = F.create_map(*[x for i, n in enumerate(TAXONOMY) for x in (F.lit(i), F.lit(n))])
    return F.concat(F.lit("  - category "), c.cast("string"), F.lit(" "), F.coalesce(F.try_element_at(names, c), F.concat(F.lit("CAT_"), c.cast("string"))))


def _lines(*parts: Column) -> Column:
    """Arrays of lines, one after the other; a null one is none."""
    return F.array_join(F.concat(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts]), "\n")


def _some(head: Column, lines: Column) -> Column:
    return F.when(F.size(lines) > 0, F.concat(F.array(head), lines))


def jurisdiction_text(pack: Column, contexts: Column) -> Column:
    over = F.transform(F.coalesce(pack["overrides"], F.array().cast("array<struct<category:int,severity_floor:int>>")), lambda o: F.concat(_category(o["category"]), F.lit(" severity_floor "), F.coalesce(o["severity_floor"], F.lit(0)).cast("string")))
    allowed = F.when(F.size(contexts) > 0, F.array(F.concat(F.lit("allowed_contexts: "), wrapped(contexts))))
    return _lines(F.array(F.concat(F.lit("id: "), F.coalesce(pack["skill_id"], F.lit("<unknown>"))), F.lit("overrides:")), over, allowed)


def community_text(pack: Column) -> Column:
    on = lambda r, k: F.when(F.coalesce(r[k], F.lit(False)), F.lit(f" {k}=true")).otherwise("")
    rules = F.transform("_rules", lambda r: F.concat(_category(r["category"]), F.lit(" action="), F.coalesce(r["action"], F.lit("warn")), on(r, "suggest_redact"), on(r, "suggest_mute")))
    age = F.when(F.length(pack["community_profile"]["age_mode"]) > 0, F.array(F.concat(F.lit("age_mode: "), pack["community_profile"]["age_mode"])))
    unknown = lambda c: F.coalesce(c, F.lit("?"))

    def counter(c: Column) -> Column:
        t = c["thresholds"]
        return F.concat(F.lit("  - "), F.coalesce(c["counter_id"], F.lit("<counter>")), F.lit(" thresholds "), unknown(t["label_at"]), F.lit("/"), unknown(F.coalesce(t["strong_label_at"], t["escalate_at"])), F.lit("/"), unknown(t["escalate_at"]))

    ident = F.array(F.concat(F.lit("id: "), F.coalesce(pack["skill_id"], F.lit("<unknown>"))))
    return _lines(ident, age, _some(F.lit("rules:"), rules), _some(F.lit("counters:"), F.transform("_counters", counter)))


def compiled(bundles: DataFrame, instruction: str, baseline_contexts: tuple[str, ...] = (), budget: int = TOKEN_BUDGET) -> DataFrame:
    """bundle, text, tokens and problem of bundles (bundle, jurisdiction, community), whose packs are structs of FIELDS, or null.

    Contexts are those of the baseline, the jurisdiction and the community, each once. `tokens` are those of the first
    four sections; beyond the budget the problem is `over_budget`, and there is no text. A rule or override without a
    category is left out. White space at the end of a section is cut.
    """
    j, c, none = F.col("jurisdiction"), F.col("community"), F.array().cast("array<string>")
    known = lambda xs: F.filter(xs, lambda x: x["category"].isNotNull())
    contexts = F.array_distinct(F.concat(F.array(*map(F.lit, baseline_contexts)).cast("array<string>"), F.coalesce(j["allowed_contexts"], none), F.coalesce(c["allowed_contexts"], none)))
    ready = bundles.select("bundle", F.when(j.isNotNull(), j.withField("overrides", known(j["overrides"]))).alias("jurisdiction"), "community", contexts.alias("_contexts"), known(c["rules"]).alias("_rules"), c["group_risk_counters"].alias("_counters"))
    cut = lambda t: F.regexp_replace(t, r"\s+$", "")
    whole = lambda pack, text: F.when(pack.isNotNull(), F.concat(F.lit("\n"), cut(text))).otherwise("")
    head = F.concat(
        F.lit(f"[INSTRUCTION]\n{instruction.rstrip()}\n\n[GLOBAL_BASELINE]\n{BASELINE}\n\n[JURISDICTION_OVERLAY]"), whole(j, jurisdiction_text(j, F.col("_contexts"))),
        F.lit("\n\n[COMMUNITY_OVERLAY]"), whole(c, community_text(c)), F.lit("\n"))
    priced = ready.select("bundle", F.inline(F.array(F.struct(head.alias("_head"))))).withColumn("tokens", estimate_tokens(F.col("_head")))
    fits = F.col("tokens") <= budget
    text = F.when(fits, F.concat("_head", F.lit(f"\n[INPUT]\n{INPUT}\n\n[OUTPUT]\n{OUTPUT}\n")))
    return priced.select("bundle", text.alias("text"), "tokens", F.when(~fits, "over_budget").alias("problem"))


def community_counters(packs: DataFrame) -> DataFrame:
    """skill_id, place, counter_id and thresholds of each counter of opened community packs, in their order."""
    each = packs.select("skill_id", F.posexplode("group_risk_counters").alias("_at", "_c"))
    at = lambda k: F.col(f"_c.thresholds.{k}").try_cast("int").alias(k)
    return each.select("skill_id", (F.col("_at") + 1).alias("place"), F.col("_c.counter_id").alias("counter_id"), at("label_at"), at("strong_label_at"), at("escalate_at"))
