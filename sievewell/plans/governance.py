"""Queries of rule packs: resolution, validation, versions, passports, revocations; with DuckDB SQL over the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievewell.functions.verdict import TAXONOMY
from sievewell.operators import packs
from sievewell.operators.asof import as_of
from sievewell.sources import openpacks
from sievewell.sources.tables import event_times, table

TODAY, SIGNING_DAY = "2026-05-15", "2001-08-01"
FIRST_DAY = 1_704_067_200_000_000  # 2024-01-01, in microseconds
SIGNERS = (None, ("legal_review", "cultural_review"), ("trust_and_safety",), (), ("trust_and_safety", "legal_review", "cultural_review"))
STATED = (None, "label_only", "warn", "strong_warn", "block", "critical_intervention", "shout")


def _pick(i, values, kind: str = "string"):
    """The value at place i, from 0, of literal values; null beyond them."""
    lit = lambda v: (F.array(*map(F.lit, v)) if isinstance(v, tuple) else F.lit(v)).cast(kind)
    return F.get(F.array(*map(lit, values)), i.cast("int"))


def pack_texts(spark, sf_dir):
    """A rule pack as JSON for each customer: keys that are there or not, values of wrong type, and texts that are no object."""
    k = F.col("c_custkey")
    number = lambda x: x.cast("int")
    one = F.array(F.struct(number(k % 18).alias("category"), number(k % 6).alias("severity_floor")))
    two = F.array(F.struct(F.lit(4).alias("category"), F.lit(2).alias("severity_floor")), F.struct(number(k % 16).alias("category"), F.lit(None).cast("int").alias("severity_floor")))
    lexicon = F.array(F.struct(F.lit("words").alias("lexicon_id"), _pick(k % 6, ("", "court")).alias("provenance")))
    body = F.to_json(F.struct(
        F.when(k % 29 != 0, F.concat(_pick(k % 4, ("sievewell.baseline.", "sievewell.jurisdiction.", "sievewell.community.", "other.")), F.lit("c"), k.cast("string"))).alias("skill_id"),
        _pick(k % 5, SIGNERS, "array<string>").alias("signed_by"), F.when(k % 3 == 1, one).when(k % 3 == 2, two).alias("overrides"),
        F.when(k % 2 == 1, F.array(F.struct(number(k % 17).alias("category"), F.lit("warn").alias("action")))).alias("rules"),
        _pick(F.when(k % 7 == 0, 0).when(k % 7 < 4, 1).otherwise(2), (None, ("NEWS_CONTEXT",), packs.CONTEXTS), "array<string>").alias("allowed_contexts"),
        F.when(k % 8 == 0, F.array().cast("array<string>")).alias("taxonomy"), F.when(k % 10 == 0, F.array().cast("array<string>")).alias("privacy_rules"), F.when(k % 6 < 3, lexicon).alias("lexicons"),
        F.when(k % 9 == 0, F.col("c_mktsegment")).alias("segment")))
    text = F.when(k % 31 == 0, F.substring(body, F.lit(1), F.length(body) - 2)).when(k % 37 == 0, F.concat(F.lit("["), body, F.lit("]"))).when(k % 82 == 0, F.regexp_replace(body, r"^\{", '{"rules":"none",')).otherwise(body)
    return table(spark, sf_dir, "customer").select(k.alias("pack"), F.when(k % 43 != 0, text).alias("text"))


def rules(spark, sf_dir):
    """A rule of a customer's bundle for each order."""
    k = F.col("o_orderkey")
    floor = F.when(k % 7 < 6, k % 7).cast("int")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("bundle"), _pick(k % 13 % 3, packs.LAYERS).alias("layer"), _pick(k % 11 % 2, ("rules", "overrides")).alias("block"),
        F.when(k % 19 != 0, k % 17).cast("int").alias("category"), floor.alias("floor"), _pick(k % 23 % 7, STATED).alias("action"))


def layers(spark, sf_dir):
    """Contexts that the layers of each customer's bundle allow; null for some."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("bundle"), F.explode(F.array(*map(F.lit, range(3)))).alias("l"))
    n = F.col("bundle") + F.col("l")
    contexts = F.when(n % 4 != 0, F.array(_pick(n % 4, packs.CONTEXTS), _pick(n % 3, packs.CONTEXTS)))
    return c.select("bundle", _pick(F.col("l"), packs.LAYERS).alias("layer"), contexts.alias("contexts"))


def artefacts(spark, sf_dir):
    """A part's artefact with the models that its pack says it fits."""
    k = F.col("p_partkey")
    right = F.md5(F.col("p_name").cast("binary"))
    entry = lambda m, d: F.struct(F.lit(m).alias("model_id"), d.alias("sha256"))
    stated = F.array(entry("m0", F.when(k % 5 == 0, F.lit(None)).when(k % 7 == 0, F.lit("00")).otherwise(F.upper(right))), entry("m1", right))
    return table(spark, sf_dir, "part").select(k.alias("skill_id"), F.concat(F.lit("m"), (k % 3).cast("string")).alias("model_id"), right.alias("sha256"), F.when(k % 11 != 0, stated).otherwise(F.array().cast("array<struct<model_id:string,sha256:string>>")).alias("entries"))


def passports(spark, sf_dir):
    k = F.col("c_custkey")
    text = lambda *xs: F.concat(*[x.cast("string") if hasattr(x, "cast") else F.lit(x) for x in xs])
    return table(spark, sf_dir, "customer").select(
        text("s", k).alias("skill_id"), text(k % 3, ".", k % 5).alias("version"), text("m", k % 30).alias("model_id"), text("1.", k % 80, F.when(k % 7 == 0, ".1").otherwise("")).alias("min_version"),
        (k % 9 != 0).alias("signature_valid"), F.date_add(_today(), (k * 37 % 900 - 200).cast("int")).alias("expires_on"))


def revoked(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").filter(k % 2 == 0).select(F.concat(F.lit("s"), k.cast("string")).alias("skill_id"), F.concat((k % 3).cast("string"), F.lit("."), (k % 5).cast("string")).alias("version"))


def runtime(spark, sf_dir):
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("m"), k.cast("string")).alias("model_id"), F.concat(F.lit("1."), (k * 3 + 1).cast("string")).alias("runtime_version"))


def section_rows(spark, sf_dir):
    """Six sections of a manifest for each supplier, some of them long."""
    k = F.col("s_suppkey")
    of = table(spark, sf_dir, "supplier").select(k.alias("manifest"), F.col("s_name"), F.explode(F.array(*map(F.lit, range(6)))).alias("place"))
    return of.select("manifest", "place", F.concat(F.lit("["), F.col("s_name"), F.lit("] "), F.repeat(F.lit("rule text "), (F.col("manifest") * 7 % 160).cast("int"))).alias("text"))


def _privacy(spark, sf_dir):
    k, n = F.col("s_suppkey"), F.col("n_nationkey")
    base = table(spark, sf_dir, "nation").select(F.concat(F.lit("p"), n.cast("string")).alias("rule_id"), F.concat(F.lit("no "), F.col("n_name")).alias("rule"))
    own = table(spark, sf_dir, "supplier").select(F.concat(F.lit("p"), (k % 40).cast("string")).alias("rule_id"), F.concat(F.lit("no "), F.col("s_name")).alias("rule"))
    return packs.privacy_intact(base, own)


def versions(spark, sf_dir):
    """Orders as registrations of pack versions: a customer's pack, versions that come again, not always in the order of signing."""
    k = F.col("o_orderkey")
    number = F.concat_ws(".", (k % 2 + 1).cast("string"), F.when(k % 5 == 0, "10").otherwise((k % 4).cast("string")))
    signed = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        k.alias("seq"), F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("skill_id"), number.alias("version"), signed.alias("signed_on"), F.date_add(signed, (k % 400).cast("int")).alias("expires_on"))


def manifests(spark, sf_dir):
    """A manifest for each supplier, some without a mark or with two in the wrong order."""
    k, name, n = F.col("s_suppkey"), F.col("s_name"), F.col("s_nationkey").cast("string")
    body = F.concat(
        F.lit("[INSTRUCTION]\nBe  brief, "), name, F.lit(".\n[x] item\n\n"), F.when(k % 5 == 0, F.lit("[INPUT]\n")).otherwise(F.lit("")), F.lit("[GLOBAL_BASELINE]"), F.lit("cat "), n, F.lit(": floor 5  \n[JURISDICTION_OVERLAY]\n"),
        F.when(k % 7 == 0, F.lit("[OUTPUT]")).otherwise(F.lit("[COMMUNITY_OVERLAY]\nnone\n[INPUT]\n{}\n[OUTPUT]\n[RULES] ")), name, F.lit("\t\n"))
    return table(spark, sf_dir, "supplier").select(k.alias("manifest"), body.alias("text"))


def _version_at_event(spark, sf_dir):
    """Events with the version of their user's pack that was registered last, and whether it still holds. Orders become registrations within the month of the events."""
    k = F.col("o_orderkey")
    at = F.timestamp_micros(F.lit(FIRST_DAY) + (k * 7919 % 43_200) * 60_000_000)
    until = F.timestamp_micros(F.unix_micros("ts") + (F.col("seq") % 10) * 86_400_000_000)
    given = table(spark, sf_dir, "orders").select((k % 150).alias("user_id"), at.alias("ts"), k.alias("seq"), F.concat(F.lit("1."), (k % 40).cast("string")).alias("version"))
    given = given.filter("user_id % 10 <> 0").withColumn("until", until)
    events = event_times(spark, sf_dir).select("event_id", "user_id", "ts")
    return as_of(events, given, ["user_id"], "ts", ["seq", "version", "until"]).select("event_id", "seq", "version", (F.col("until") >= F.col("ts")).alias("holds"))


def _kept(spark, sf_dir):
    return packs.history(versions(spark, sf_dir))


_today = lambda: F.lit(TODAY).cast("date")
_signing_day = lambda: F.lit(SIGNING_DAY).cast("date")


def _opened(spark, sf_dir):
    return openpacks.pack_rows(pack_texts(spark, sf_dir))


def _good(spark, sf_dir):
    return openpacks.parted(_opened(spark, sf_dir))[0]


def _named(spark, sf_dir):
    names = spark.createDataFrame(list(enumerate(TAXONOMY[:15])), "category int, name string")
    got = packs.resolve(rules(spark, sf_dir), "bundle").join(F.broadcast(names), "category", "left")
    return got.select("bundle", "category", F.coalesce("name", F.concat(F.lit("CAT_"), F.col("category").cast("string"))).alias("name"))


QUERIES = {
    "resolve_rules": lambda s, d: packs.resolve(rules(s, d), "bundle"),
    "taxonomy_join": _named,
    "allowed_contexts": lambda s, d: packs.allowed_contexts(layers(s, d)).select("bundle", F.array_join("contexts", ",").alias("contexts")),
    "pack_open": lambda s, d: _opened(s, d).select("pack", "skill_id", "problem", "has_taxonomy", "has_privacy"),
    "pack_violations": lambda s, d: packs.violations(_good(s, d)),
    "pack_kinds": lambda s, d: _good(s, d).select("skill_id", packs.pack_kind(F.col("skill_id")).alias("kind")),
    "manifest_tokens": lambda s, d: packs.manifest_tokens(section_rows(s, d)),
    "manifest_sections": lambda s, d: packs.sections(manifests(s, d)),
    "pack_checksums": lambda s, d: packs.checksums_agree(artefacts(s, d)),
    "privacy_intact": _privacy,
    "pack_history": _kept,
    "version_at_event": _version_at_event,
    "pack_rollback": lambda s, d: packs.rollback(_kept(s, d)),
    "pack_active": lambda s, d: _kept(s, d).filter("is_active").select("skill_id", "version"),
    "pack_expiring": lambda s, d: packs.expiring(_kept(s, d), _signing_day()).select("skill_id", "version", "expires_on"),
    "pack_deactivate": lambda s, d: packs.deactivated(_kept(s, d), _signing_day()).select("skill_id", "version", "is_active"),
    "pack_review": lambda s, d: packs.review_queue(_kept(s, d), _signing_day()).select("place", "skill_id", "version", "expires_on"),
    "revoked_packs": lambda s, d: passports(s, d).select("skill_id", "version").join(revoked(s, d), ["skill_id", "version"], "left_semi"),
    "valid_packs": lambda s, d: passports(s, d).select("skill_id", "version").join(revoked(s, d), ["skill_id", "version"], "left_anti"),
    "model_compat": lambda s, d: passports(s, d).join(runtime(s, d), "model_id").select("skill_id", "model_id", packs.at_least(F.col("runtime_version"), F.col("min_version")).alias("fits")),
    "passport_status": lambda s, d: packs.passport_status(passports(s, d), revoked(s, d), runtime(s, d), _today()),
}


def _sql(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, int):
        return str(x)
    if isinstance(x, tuple):
        inner = ", ".join(f"{{'category': {_sql(e[0])}, 'floor': {_sql(e[1])}}}" if isinstance(e, tuple) else _sql(e) for e in x)
        return f"[{inner}]"
    return "'" + x.replace("'", "''") + "'"


_CONTEXT = "['QUOTED_SPEECH_CONTEXT', 'NEWS_CONTEXT', 'EDUCATION_CONTEXT', 'COUNTERSPEECH_CONTEXT']"
_LEVEL = "list_position(['baseline', 'jurisdiction', 'community'], layer)"
_RANK = "coalesce(list_position(['label_only', 'warn', 'strong_warn', 'block', 'critical_intervention'], act), 0)"
_RESOLVED = f"""WITH rules AS (
  SELECT o_custkey AS bundle, ['baseline', 'jurisdiction', 'community'][o_orderkey % 13 % 3 + 1] AS layer, ['rules', 'overrides'][o_orderkey % 11 % 2 + 1] AS block, CASE WHEN o_orderkey % 19 <> 0 THEN o_orderkey % 17 END::INTEGER AS category,
    CASE WHEN o_orderkey % 7 < 6 THEN o_orderkey % 7 END::INTEGER AS floor, [NULL, 'label_only', 'warn', 'strong_warn', 'block', 'critical_intervention', 'shout'][o_orderkey % 23 % 7 + 1] AS action FROM orders
), acts AS (
  SELECT *, CASE WHEN block = 'rules' THEN coalesce(action, 'warn') WHEN floor = 5 THEN 'critical_intervention' WHEN floor = 4 THEN 'strong_warn' WHEN floor = 3 THEN 'warn' ELSE 'label_only' END AS act
  FROM rules WHERE layer IN ('jurisdiction', 'community') AND category <> 1
), best AS (
  SELECT bundle, category, max(CASE WHEN block = 'rules' THEN 0 ELSE coalesce(floor, 0) END) AS floor, max({{'r': {_RANK}, 'act': act}}) AS top, max(CASE WHEN block = 'rules' THEN {{'l': {_LEVEL}, 'layer': layer}} END).layer AS own, min({{'l': {_LEVEL}, 'layer': layer}}).layer AS first, count(*) AS n
  FROM acts GROUP BY bundle, category
), resolved AS (
  SELECT bundle, category, floor::INTEGER AS severity_floor, CASE WHEN n > 1 AND top.r = 0 THEN 'label_only' ELSE top.act END AS action, coalesce(own, first) AS source FROM best
  UNION ALL SELECT DISTINCT bundle, 1, 5, 'critical_intervention', 'baseline' FROM rules
)"""
_KEY = "list_transform(string_split({}, '.'), lambda x: coalesce(TRY_CAST(regexp_extract(x, '^\\d+') AS INTEGER), 0))"
_CANDIDATES = "list_reverse_sort(list_append(list_filter(a, lambda v: v.version <> x[1].version), x[1]))[:3]"
_HISTORY = f"""WITH given AS (
  SELECT o_orderkey AS seq, 's' || o_custkey AS skill_id, (o_orderkey % 2 + 1) || '.' || CASE WHEN o_orderkey % 5 = 0 THEN '10' ELSE (o_orderkey % 4)::VARCHAR END AS version,
    o_orderdate::DATE AS signed_on, o_orderdate::DATE + (o_orderkey % 400)::INTEGER AS expires_on FROM orders
), folded AS (
  SELECT skill_id, list_reduce(list([{{'signed_on': signed_on, 'key': {_KEY.format('version')}, 'seq': seq, 'version': version, 'expires_on': expires_on}}] ORDER BY seq),
    lambda a, x: CASE WHEN list_contains(list_transform({_CANDIDATES}, lambda v: v.seq), x[1].seq) THEN {_CANDIDATES} ELSE a END) AS kept FROM given GROUP BY skill_id
), history AS (
  SELECT skill_id, v.version AS version, v.signed_on AS signed_on, v.expires_on AS expires_on, place::INTEGER AS place, place = 1 AS is_active
  FROM (SELECT skill_id, unnest(kept) AS v, generate_subscripts(kept, 1) AS place FROM folded)
)"""
_PASS = f"""WITH passports AS (
  SELECT 's' || c_custkey AS skill_id, (c_custkey % 3) || '.' || (c_custkey % 5) AS version, 'm' || (c_custkey % 30) AS model_id, '1.' || (c_custkey % 80) || CASE WHEN c_custkey % 7 = 0 THEN '.1' ELSE '' END AS min_version,
    c_custkey % 9 <> 0 AS signature_valid, DATE '{TODAY}' + (c_custkey * 37 % 900 - 200)::INTEGER AS expires_on FROM customer
), revoked AS (SELECT 's' || s_suppkey AS skill_id, (s_suppkey % 3) || '.' || (s_suppkey % 5) AS version FROM supplier WHERE s_suppkey % 2 = 0
), runtime AS (SELECT 'm' || n_nationkey AS model_id, '1.' || (n_nationkey * 3 + 1) AS runtime_version FROM nation)"""
_LONGER = f"greatest(len({_KEY.format('runtime_version')}), len({_KEY.format('min_version')}))"
_FULL = lambda c: f"list_resize({_KEY.format(c)}, {_LONGER}, 0)"
_FITS = f"{_FULL('runtime_version')} >= {_FULL('min_version')}"
_D, _S = f"DATE '{TODAY}'", f"DATE '{SIGNING_DAY}'"
_PACKS = f"""WITH made AS (
  SELECT *, ['sievewell.baseline.', 'sievewell.jurisdiction.', 'sievewell.community.', 'other.'][k % 4 + 1] || 'c' || k AS id, k % 43 <> 0 AND k % 31 <> 0 AND k % 37 <> 0 AS is_object, k % 82 = 0 AS mistyped FROM (SELECT c_custkey AS k FROM customer)
), packs AS (
  SELECT k AS pack, CASE WHEN is_object AND k % 29 <> 0 THEN id END AS skill_id,
    CASE WHEN k % 43 = 0 OR k % 31 = 0 THEN 'not_json' WHEN NOT is_object THEN 'not_an_object' WHEN k % 29 = 0 THEN 'missing_skill_id' WHEN mistyped THEN 'type_rules' END AS problem,
    [NULL, ['legal_review', 'cultural_review'], ['trust_and_safety'], []::VARCHAR[], ['trust_and_safety', 'legal_review', 'cultural_review']][k % 5 + 1] AS signers,
    CASE k % 3 WHEN 1 THEN [{{'category': k % 18, 'floor': k % 6}}] WHEN 2 THEN [{{'category': 4, 'floor': 2}}, {{'category': k % 16, 'floor': NULL}}] END AS overrides, CASE WHEN k % 2 = 1 THEN [k % 17] END AS rule_categories,
    CASE WHEN k % 7 > 3 THEN ['QUOTED_SPEECH_CONTEXT', 'NEWS_CONTEXT', 'EDUCATION_CONTEXT', 'COUNTERSPEECH_CONTEXT'] WHEN k % 7 > 0 THEN ['NEWS_CONTEXT'] END AS contexts,
    is_object AND k % 8 = 0 AS has_taxonomy, is_object AND k % 10 = 0 AS has_privacy, CASE k % 6 WHEN 0 THEN [''] WHEN 1 THEN ['court'] WHEN 2 THEN [NULL] END AS provenance FROM made
), kinds AS (
  SELECT * REPLACE (coalesce(signers, []) AS signers, coalesce(overrides, []) AS overrides, coalesce(rule_categories, []) AS rule_categories, coalesce(contexts, []) AS contexts, coalesce(provenance, []) AS provenance),
    CASE WHEN starts_with(skill_id, 'sievewell.baseline.') THEN 'baseline' WHEN starts_with(skill_id, 'sievewell.jurisdiction.') THEN 'jurisdiction' WHEN starts_with(skill_id, 'sievewell.community.') THEN 'community' END AS kind FROM packs WHERE problem IS NULL
)"""
_SIGN = "kind = 'jurisdiction' AND NOT list_has_all(signers, ['legal_review', 'cultural_review']) OR kind = 'community' AND NOT list_contains(signers, 'trust_and_safety')"
_BROKEN = f"""list_filter([CASE WHEN kind IS NULL THEN 'UNKNOWN_KIND' END, CASE WHEN len(list_filter(list_concat(list_transform(overrides, lambda o: o.category), rule_categories), lambda c: c IS NULL OR c NOT BETWEEN 0 AND 15)) > 0 THEN 'CATEGORY_RANGE' END,
  CASE WHEN kind <> 'baseline' AND has_taxonomy THEN 'OWN_TAXONOMY' END, CASE WHEN {_SIGN} THEN 'SIGNER_MISSING' END,
  CASE WHEN len(list_filter(overrides, lambda o: o.floor >= 4)) > 0 AND NOT list_has_all(contexts, ['QUOTED_SPEECH_CONTEXT', 'NEWS_CONTEXT', 'EDUCATION_CONTEXT', 'COUNTERSPEECH_CONTEXT']) THEN 'CONTEXTS_MISSING' END,
  CASE WHEN kind <> 'baseline' AND has_privacy THEN 'PRIVACY_IN_OVERLAY' END, CASE WHEN len(list_filter(provenance, lambda p: coalesce(p, '') = '')) > 0 OR len(provenance) > 0 AND len(signers) = 0 THEN 'LEXICON_PROVENANCE' END], lambda x: x IS NOT NULL)"""
_MARKS = ("[INSTRUCTION]", "[GLOBAL_BASELINE]", "[JURISDICTION_OVERLAY]", "[COMMUNITY_OVERLAY]", "[INPUT]", "[OUTPUT]")


def _marks() -> str:
    """A step for each mark: i where it begins, c behind it and a line end; 0 from the first that is missing on."""
    steps = ["c0 AS (SELECT manifest, text, 1 AS c0 FROM given)"]
    for i, m in enumerate(_MARKS):
        steps.append(f"p{i} AS (SELECT *, CASE WHEN c{i} > 0 AND strpos(substring(text, c{i}), '{m}') > 0 THEN c{i} + strpos(substring(text, c{i}), '{m}') - 1 ELSE 0 END AS i{i} FROM c{i})")
        steps.append(f"c{i + 1} AS (SELECT *, CASE WHEN i{i} > 0 THEN i{i} + {len(m)} + (substring(text, i{i} + {len(m)}, 1) = chr(10))::INTEGER ELSE 0 END AS c{i + 1} FROM p{i})")
    return ", ".join(steps)


_SECTIONS = f"""WITH given AS (
  SELECT s_suppkey AS manifest, '[INSTRUCTION]' || chr(10) || 'Be  brief, ' || s_name || '.' || chr(10) || '[x] item' || chr(10) || chr(10) || CASE WHEN s_suppkey % 5 = 0 THEN '[INPUT]' || chr(10) ELSE '' END
    || '[GLOBAL_BASELINE]cat ' || s_nationkey || ': floor 5  ' || chr(10) || '[JURISDICTION_OVERLAY]' || chr(10)
    || CASE WHEN s_suppkey % 7 = 0 THEN '[OUTPUT]' ELSE '[COMMUNITY_OVERLAY]' || chr(10) || 'none' || chr(10) || '[INPUT]' || chr(10) || '{{}}' || chr(10) || '[OUTPUT]' || chr(10) || '[RULES] ' END || s_name || chr(9) || chr(10) AS text FROM supplier
), {_marks()}
""" + " UNION ALL ".join(
    f"SELECT manifest, '{m[1:-1]}' AS section, rtrim(substring(text, c{i + 1}, {f'i{i + 1}' if i < 5 else 'length(text) + 1'} - c{i + 1}), ' ' || chr(9) || chr(10)) AS text, NULL::VARCHAR AS missing FROM c6 WHERE c6.c6 > 0" for i, m in enumerate(_MARKS)
) + " UNION ALL SELECT manifest, NULL, NULL, CASE " + " ".join(f"WHEN i{i} = 0 THEN '{m[1:-1]}'" for i, m in enumerate(_MARKS)) + " END FROM c6 WHERE c6.c6 = 0"
ORACLES = {
    "resolve_rules": f"{_RESOLVED} SELECT * FROM resolved",
    "taxonomy_join": f"{_RESOLVED} SELECT bundle, category, coalesce({_sql(TAXONOMY[:15])}[category + 1], 'CAT_' || category) AS name FROM resolved",
    "allowed_contexts": f"""WITH layers AS (
      SELECT bundle, ['baseline', 'jurisdiction', 'community'][l + 1] AS layer, CASE WHEN (bundle + l) % 4 <> 0 THEN [{_CONTEXT}[(bundle + l) % 4 + 1], {_CONTEXT}[(bundle + l) % 3 + 1]] END AS contexts FROM (SELECT c_custkey AS bundle, unnest([0, 1, 2]) AS l FROM customer)
    ), each AS (
      SELECT bundle, {_LEVEL} AS l, unnest(contexts) AS c, unnest(range(len(contexts))) AS i FROM layers
    ), first AS (SELECT bundle, c, min({{'l': l, 'i': i}}) AS place FROM each GROUP BY bundle, c)
    SELECT bundle, coalesce(string_agg(c, ',' ORDER BY place) FILTER (c IS NOT NULL), '') AS contexts FROM (SELECT DISTINCT bundle FROM layers) LEFT JOIN first USING (bundle) GROUP BY bundle""",
    "pack_open": f"{_PACKS} SELECT pack, skill_id, problem, has_taxonomy, has_privacy FROM packs",
    "pack_violations": f"{_PACKS} SELECT skill_id, unnest({_BROKEN}) AS rule FROM kinds",
    "pack_kinds": f"{_PACKS} SELECT skill_id, kind FROM kinds",
    "manifest_tokens": "WITH sections AS (SELECT s_suppkey AS manifest, unnest(range(6)) AS place, '[' || s_name || '] ' || repeat('rule text ', s_suppkey * 7 % 160) AS text FROM supplier) SELECT manifest, tokens, tokens <= 1800 AS fits FROM (SELECT manifest, ceil(length(string_agg(text, chr(10) ORDER BY place)) / 4)::BIGINT AS tokens FROM sections GROUP BY manifest)",
    "manifest_sections": _SECTIONS,
    "pack_checksums": """WITH a AS (SELECT p_partkey AS skill_id, 'm' || p_partkey % 3 AS model_id, md5(p_name) AS digest FROM part)
      SELECT skill_id, skill_id % 11 <> 0 AND (model_id = 'm1' OR model_id = 'm0' AND (skill_id % 5 = 0 OR skill_id % 7 <> 0)) AS agree FROM a""",
    "privacy_intact": """SELECT 'p' || s_suppkey % 40 AS rule_id, 'no ' || s_name AS overlay, 'no ' || n_name AS baseline FROM supplier LEFT JOIN nation ON n_nationkey = s_suppkey % 40""",
    "pack_history": f"{_HISTORY} SELECT skill_id, version, signed_on, expires_on, place, is_active FROM history",
    "version_at_event": """WITH v AS (
      SELECT o_orderkey % 150 AS user_id, TIMESTAMP '2024-01-01' + to_minutes(o_orderkey * 7919 % 43200) AS signed, o_orderkey AS seq, '1.' || o_orderkey % 40 AS version FROM orders WHERE o_orderkey % 150 % 10 <> 0
    )
    SELECT event_id, seq, version, signed + to_days((seq % 10)::INTEGER) >= ts AS holds FROM events e LEFT JOIN v ON v.user_id = e.user_id AND signed <= ts
    QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY signed DESC, seq DESC) = 1""",
    "pack_rollback": f"{_HISTORY} SELECT skill_id, version FROM history WHERE place = 2",
    "pack_active": f"{_HISTORY} SELECT skill_id, version FROM history WHERE is_active",
    "pack_expiring": f"{_HISTORY} SELECT skill_id, version, expires_on FROM history WHERE is_active AND expires_on <= {_S} + 30",
    "pack_deactivate": f"{_HISTORY} SELECT skill_id, version, is_active AND expires_on >= {_S} AS is_active FROM history",
    "pack_review": f"{_HISTORY} SELECT row_number() OVER (ORDER BY expires_on, skill_id)::INTEGER AS place, skill_id, version, expires_on FROM history WHERE is_active AND expires_on BETWEEN {_S} AND {_S} + 30",
    "revoked_packs": f"{_PASS} SELECT skill_id, version FROM passports WHERE (skill_id, version) IN (SELECT (skill_id, version) FROM revoked)",
    "valid_packs": f"{_PASS} SELECT skill_id, version FROM passports WHERE (skill_id, version) NOT IN (SELECT (skill_id, version) FROM revoked)",
    "model_compat": f"{_PASS} SELECT skill_id, model_id, {_FITS} AS fits FROM passports JOIN runtime USING (model_id)",
    "passport_status": f"""{_PASS} SELECT p.skill_id, p.version, CASE WHEN NOT signature_valid THEN 'bad_signature' WHEN r.skill_id IS NOT NULL THEN 'revoked' WHEN expires_on::DATE < {_D} THEN 'expired'
      WHEN expires_on::DATE - {_D} > 540 THEN 'validity_too_long' WHEN t.model_id IS NULL OR NOT ({_FITS}) THEN 'model_mismatch' ELSE 'ok' END AS status
      FROM passports p LEFT JOIN revoked r ON r.skill_id = p.skill_id AND r.version = p.version LEFT JOIN runtime t ON t.model_id = p.model_id""",
}
