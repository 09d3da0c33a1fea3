"""Layered rule packs: resolution, validation, versions, passports and revocations, as relational steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Actions from least to most protective, and layers from general to specific.
ACTIONS = ("label_only", "warn", "strong_warn", "block", "critical_intervention")
LAYERS = ("baseline", "jurisdiction", "community")
SIGNERS = {"jurisdiction": ("legal_review", "cultural_review"), "community": ("trust_and_safety",)}
CONTEXTS = ("QUOTED_SPEECH_CONTEXT", "NEWS_CONTEXT", "EDUCATION_CONTEXT", "COUNTERSPEECH_CONTEXT")
SECTIONS = ("INSTRUCTION", "GLOBAL_BASELINE", "JURISDICTION_OVERLAY", "COMMUNITY_OVERLAY", "INPUT", "OUTPUT")
TOKEN_BUDGET, KEEP, SOON_DAYS, MOST_DAYS = 1800, 3, 30, 540


def action_rank(action: Column) -> Column:
    """1 to 5; 0 for an action that is not known."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(a) for a in ACTIONS]), action), F.lit(0)), F.lit(0)).cast("int")


def default_action(severity: Column) -> Column:
    return F.when(severity == 5, "critical_intervention").when(severity == 4, "strong_warn").when(severity == 3, "warn").otherwise("label_only")


def resolve(rules: DataFrame, *by: str) -> DataFrame:
    """The active rule of each category, and of the columns `by`, over (layer, block, category, floor, action) rows of the overlays.

    The highest floor and the most protective action win. An `overrides` row has the action of its floor, whatever
    it states; a `rules` row has no floor, and warns if it states no action. An action that is not known is kept if a
    category has no other row, and else counts as `label_only`. The source is the most specific layer with a `rules` row,
    else the first that names the category. Child safety is always there, as the baseline has it; other rows of
    the baseline resolve nothing, and rows without a category are left out. Every value of `by` that has a row has child safety.
    """
    level = F.array_position(F.array(*[F.lit(x) for x in LAYERS]), F.col("layer")).cast("int")
    own, floor = F.col("block") == "rules", F.coalesce("floor", F.lit(0))
    act = F.when(own, F.coalesce("action", F.lit("warn"))).otherwise(default_action(floor))
    folded = rules.filter(F.col("layer").isin(*LAYERS[1:]) & (F.col("category") != 1))
    ranked = folded.select(*by, "category", F.when(own, 0).otherwise(floor).alias("floor"), F.struct(action_rank(act).alias("rank"), act.alias("action")).alias("act"), F.when(own, F.struct(level.alias("l"), "layer")).alias("own"), F.struct(level.alias("l"), "layer").alias("any"))
    got = ranked.groupBy(*by, "category").agg(F.max("floor").alias("floor"), F.max("act").alias("act"), F.max("own").alias("own"), F.min("any").alias("any"), F.count(F.lit(1)).alias("n"))
    action = F.when((F.col("n") > 1) & (F.col("act.rank") == 0), "label_only").otherwise(F.col("act.action"))
    out = got.select(*by, "category", F.col("floor").cast("int").alias("severity_floor"), action.alias("action"), F.coalesce("own.layer", "any.layer").alias("source"))
    every = rules.select(*by).distinct() if by else rules.sparkSession.range(1)
    child = every.select(*by, F.lit(1).alias("category"), F.lit(5).alias("severity_floor"), F.lit("critical_intervention").alias("action"), F.lit("baseline").alias("source"))
    return out.unionByName(child)


def allowed_contexts(layers: DataFrame) -> DataFrame:
    """The contexts of a bundle's layers in layer order, each once."""
    level = F.array_position(F.array(*[F.lit(x) for x in LAYERS]), F.col("layer"))
    got = layers.groupBy("bundle").agg(F.sort_array(F.collect_list(F.struct(level.alias("l"), "contexts"))).alias("x"))
    return got.select("bundle", F.array_distinct(F.flatten(F.transform("x", lambda e: F.coalesce(e["contexts"], F.array().cast("array<string>"))))).alias("contexts"))


def pack_kind(skill_id: Column, prefix: str = "sievewell") -> Column:
    out = F.lit(None).cast("string")
    for layer in LAYERS:
        out = F.when(skill_id.startswith(f"{prefix}.{layer}."), F.lit(layer)).otherwise(out)
    return out


def violations(packs: DataFrame) -> DataFrame:
    """skill_id and broken rule: a row for each rule that a pack breaks. `provenance` has an entry for each lexicon."""
    kind, empty = pack_kind(F.col("skill_id")), F.array().cast("array<string>")
    wanted = F.create_map(*[x for k, v in SIGNERS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    over = F.coalesce("overrides", F.array().cast("array<struct<category:int,floor:int>>"))
    named = F.concat(F.transform(over, lambda o: o["category"]), F.coalesce("rule_categories", F.array().cast("array<int>")))
    shipped = F.coalesce("provenance", empty)
    lacking = F.array_except(F.try_element_at(wanted, kind), F.coalesce("signers", empty))
    overlay = kind != "baseline"
    rules = {
        "UNKNOWN_KIND": kind.isNull(),
        "CATEGORY_RANGE": F.exists(named, lambda c: c.isNull() | ~c.between(0, 15)),
        "OWN_TAXONOMY": overlay & F.col("has_taxonomy"),
        "SIGNER_MISSING": F.size(lacking) > 0,
        "CONTEXTS_MISSING": F.exists(over, lambda o: F.coalesce(o["floor"], F.lit(0)) >= 4) & (F.size(F.array_except(F.array(*[F.lit(c) for c in CONTEXTS]), F.coalesce("contexts", empty))) > 0),
        "PRIVACY_IN_OVERLAY": overlay & F.col("has_privacy"),
        "LEXICON_PROVENANCE": F.exists(shipped, lambda p: p.isNull() | (p == "")) | ((F.size(shipped) > 0) & (F.size(F.coalesce("signers", empty)) == 0)),
    }
    broken = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return packs.select("skill_id", F.explode(broken).alias("rule"))


def version_key(version: Column) -> Column:
    """Numbers of a dotted version: leading digits of each part, 0 where there are none."""
    return F.transform(F.split(version, r"\."), lambda x: F.coalesce(F.regexp_extract(x, r"^\d+", 0).try_cast("int"), F.lit(0)))


def at_least(version: Column, least: Column) -> Column:
    """Whether a version is not below another, the shorter one filled up with zeros."""
    a, b = version_key(version), version_key(least)
    full = lambda x, y: F.concat(x, F.array_repeat(F.lit(0), F.greatest(F.size(y) - F.size(x), F.lit(0))))
    return full(a, b) >= full(b, a)


def history(registered: DataFrame) -> DataFrame:
    """The versions kept of each skill, newest first, with the active one, after all registrations in the order of `seq`.

    A registration replaces an equal version, and the KEEP newest by signing date, then version, then registration stay.
    One that is older than all of these changes nothing, also if it would replace one: a fold over a skill's
    registrations, of which KEEP are remembered. They are gathered in a row for each skill, as a pack is signed now and then.
    """
    key = version_key(F.col("version"))
    one = F.struct("signed_on", key.alias("key"), F.col("seq").cast("long").alias("seq"), "version", "expires_on")
    given = registered.groupBy("skill_id").agg(F.array_sort(F.collect_list(F.struct(F.col("seq").cast("long").alias("at"), one.alias("v")))).alias("given"))

    def step(kept: Column, entry: Column) -> Column:
        new = entry["v"]
        ranked = F.slice(F.sort_array(F.concat(F.filter(kept, lambda v: v["version"] != new["version"]), F.array(new)), asc=False), 1, KEEP)
        return F.transform(F.array(ranked), lambda r: F.when(F.exists(r, lambda v: v["seq"] == new["seq"]), r).otherwise(kept))[0]

    none = F.filter(F.transform("given", lambda e: e["v"]), lambda v: F.lit(False))
    kept = given.select("skill_id", F.posexplode(F.aggregate("given", none, step)).alias("place", "v"))
    return kept.select("skill_id", "v.version", "v.signed_on", "v.expires_on", (F.col("place") + 1).alias("place"), (F.col("place") == 0).alias("is_active"))


def rollback(kept: DataFrame) -> DataFrame:
    """The version that becomes active when the newest is dropped; skills with one version have none."""
    return kept.filter("place = 2").select("skill_id", "version")


def expiring(kept: DataFrame, today: Column) -> DataFrame:
    return kept.filter(F.col("is_active") & (F.col("expires_on") <= F.date_add(today, SOON_DAYS)))


def deactivated(kept: DataFrame, today: Column) -> DataFrame:
    return kept.withColumn("is_active", F.col("is_active") & (F.col("expires_on") >= today))


def review_queue(kept: DataFrame, today: Column) -> DataFrame:
    due = kept.filter(F.col("is_active") & F.col("expires_on").between(today, F.date_add(today, SOON_DAYS)))
    return due.withColumn("place", F.row_number().over(Window.orderBy("expires_on", "skill_id")))


def passport_status(passports: DataFrame, revoked: DataFrame, runtime: DataFrame, today: Column, most_days: int = MOST_DAYS) -> DataFrame:
    """The first check that a passport fails: signature, revocation, expiry, validity, model; `ok` if none."""
    gone = revoked.select("skill_id", "version", F.lit(True).alias("gone")).distinct()
    fits = passports.join(runtime, "model_id").filter(at_least(F.col("runtime_version"), F.col("min_version"))).select("skill_id", "version", F.lit(True).alias("fits")).distinct()
    got = passports.join(gone, ["skill_id", "version"], "left").join(fits, ["skill_id", "version"], "left")
    status = (
        F.when(~F.col("signature_valid"), "bad_signature").when(F.col("gone"), "revoked").when(F.col("expires_on") < today, "expired")
        .when(F.datediff("expires_on", today) > most_days, "validity_too_long").when(F.col("fits").isNull(), "model_mismatch").otherwise("ok")
    )
    return got.select("skill_id", "version", status.alias("status"))


def manifest_tokens(sections: DataFrame) -> DataFrame:
    """Estimated tokens of each manifest, and whether they are within the budget."""
    from sievewell.functions.text import estimate_tokens

    whole = sections.groupBy("manifest").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda s: s["text"]), "\n").alias("text"))
    return whole.select("manifest", estimate_tokens(F.col("text")).alias("tokens")).withColumn("fits", F.col("tokens") <= TOKEN_BUDGET)


def checksums_agree(passports: DataFrame) -> DataFrame:
    """skill_id and whether a compatible entry has the artefact's digest, or states none. `entries` are (model_id, sha256)."""
    ok = F.exists("entries", lambda e: (e["model_id"] == F.col("model_id")) & (e["sha256"].isNull() | (F.lower(e["sha256"]) == F.lower(F.col("sha256")))))
    return passports.select("skill_id", F.coalesce(ok, F.lit(False)).alias("agree"))


def sections(manifests: DataFrame) -> DataFrame:
    """Manifest texts cut at the marks of SECTIONS, which must follow each other in this order: a row for each section, its
    text as it stands but for white space at its end. A manifest that lacks a mark has one row, with the first missing mark."""
    trail, cut, text = r"[ \t\n\r\f\x0B]+$", manifests.select("manifest", "text"), F.coalesce("text", F.lit(""))
    cut = cut.withColumn("_c0", F.lit(1))
    for i, name in enumerate(SECTIONS):
        mark = f"[{name}]"
        cut = cut.withColumn(f"_i{i}", F.expr(f"CASE WHEN _c{i} > 0 THEN locate('{mark}', coalesce(text, ''), _c{i}) ELSE 0 END"))
        after = F.col(f"_i{i}") + len(mark)
        skip = F.when(F.substring(text, after, F.lit(1)) == "\n", 1).otherwise(0)
        cut = cut.withColumn(f"_c{i + 1}", F.when(F.col(f"_i{i}") > 0, after + skip).otherwise(0))
    missing = F.coalesce(*[F.when(F.col(f"_i{i}") == 0, F.lit(n)) for i, n in enumerate(SECTIONS)])
    last = len(SECTIONS) - 1
    ends = [F.col(f"_i{i + 1}") if i < last else F.length(text) + 1 for i in range(len(SECTIONS))]
    bodies = [F.struct(F.lit(n).alias("section"), F.regexp_replace(F.substring(text, F.col(f"_c{i + 1}"), ends[i] - F.col(f"_c{i + 1}")), trail, "").alias("text")) for i, n in enumerate(SECTIONS)]
    none = F.array(F.struct(F.lit(None).cast("string").alias("section"), F.lit(None).cast("string").alias("text")))
    found = cut.select("manifest", missing.alias("missing"), F.explode(F.when(missing.isNull(), F.array(*bodies)).otherwise(none)).alias("s"))
    return found.select("manifest", "s.section", "s.text", "missing")


def privacy_intact(baseline: DataFrame, overlays: DataFrame, key: str = "rule_id", text: str = "rule") -> DataFrame:
    """Privacy rules that overlays state, be they new, changed or the same, with the baseline's; a release needs this to be empty."""
    return overlays.alias("o").join(baseline.alias("b"), key, "left").select(key, F.col(f"o.{text}").alias("overlay"), F.col(f"b.{text}").alias("baseline"))
