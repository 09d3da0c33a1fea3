"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one
bit per failed rule; a policy is a named, versioned set of bits, so that policies and
ablations are bitwise arithmetic on the ledger and never read a text again.

Cases: a null text counts as an empty one, which has no words and fails TOO_FEW_WORDS;
rows with equal ids are judged one by one; a null id is kept; other columns of the input
are ignored by `ledger` and returned untouched by `kept`. An empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewell.llm.common import BLANKS, WORD, bind, chars_of, words

SYMBOLS = "#*$%&|<>"
UPPER = "A-Z"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_shouts")


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    fails: str  # SQL over MEASURES

    @property
    def mask(self) -> int:
        return 1 << self.bit


RULES = (
    Rule(0, "TOO_FEW_WORDS", "n_words < 50"),
    Rule(1, "REPEATED_WORDS", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "SYMBOLS", "10 * n_symbols > 2 * n_words"),
    Rule(3, "SHOUTING", "100 * n_upper > 50 * word_chars OR 10 * n_shouts > 3 * n_words"),
    Rule(4, "REPEATED_LINES", "100 * n_dup_lines > 60 * n_lines"),
    Rule(5, "WORD_LENGTH", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
)
BASE = RULES[0].mask | RULES[1].mask
#: Versioned policies: the bits of which any one rejects a document.
POLICIES = {"base-1": BASE, "web-1": BASE | RULES[2].mask | RULES[3].mask, "web-2": sum(r.mask for r in RULES)}
CURRENT = "web-2"


def repeated_words(w: Column) -> Column:
    """Of the array of words `w`: how many lie in a 3-word window that the text has twice or more.

    Windows are compared by a 64-bit hash of their words, within one text only.
    Only texts with an equal pair of windows pay for sorting: equal windows become
    neighbours, the starts of those that have an equal neighbour are sorted again, and
    each start covers three words less what the next one covers.
    """

    def covered(starts: Column) -> Column:
        gaps = F.zip_with(starts, F.slice(starts, F.lit(2), F.size(starts)), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda n, gap: n + gap)

    def starts(at: Column) -> Column:
        equal = F.filter(at, lambda x, i: (x["win"] == F.get(at, i - 1)["win"]) | (x["win"] == F.get(at, i + 1)["win"]))
        return F.sort_array(F.transform(equal, lambda x: x["at"]))

    def of(win: Column) -> Column:
        placed = F.sort_array(F.transform(win, lambda x, i: F.struct(x.alias("win"), i.alias("at"))))
        found = bind(bind(placed, starts), covered)
        return F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0).cast("long")).otherwise(found)

    wins = F.transform(F.slice(w, 3, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), x))
    return F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(bind(wins, of))


def measured(text: Column) -> Column:
    """All measurements of a text, as a struct of longs named as in MEASURES."""
    long = lambda c: c.cast("long")

    def of(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
        by_words = bind(words(t), lambda w: F.struct(long(F.size(w)).alias("n"), F.coalesce(repeated_words(w), F.lit(0)).alias("again")))
        by_lines = bind(lines, lambda x: F.struct(long(F.size(x)).alias("n"), long(F.size(x) - F.size(F.array_distinct(x))).alias("again")))
        counts = ((long(F.length(t)) - chars_of(t, BLANKS)).alias("word_chars"), chars_of(t, SYMBOLS).alias("n_symbols"), chars_of(t, UPPER).alias("n_upper"), chars_of(t, "!").alias("n_shouts"))
        return F.struct(by_words.alias("words"), by_lines.alias("lines"), *counts)

    def flat(m: Column) -> Column:
        got = {"n_words": m["words"]["n"], "n_repeat_words": m["words"]["again"], "n_lines": m["lines"]["n"], "n_dup_lines": m["lines"]["again"]}
        return F.struct(*[(got[k] if k in got else m[k]).alias(k) for k in MEASURES])

    return bind(bind(F.coalesce(text, F.lit("")), of), flat)


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and `failed`, the bits of the rules that the document fails."""
    measures = docs.select("doc_id", measured(F.col("text")).alias("m")).select("doc_id", "m.*")
    bits = [F.when(F.expr(r.fails), F.lit(r.mask)).otherwise(F.lit(0)).cast("long") for r in RULES]
    mask = bits[0]
    for bit in bits[1:]:
        mask = mask.bitwiseOR(bit)
    return measures.withColumn("failed", mask)


def rejects(policy: str = CURRENT, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(POLICIES[policy]).cast("long")) != 0


def kept(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The rows of `docs` that the policy keeps, with all their columns."""
    mask = F.lit(0).cast("long")
    for r in RULES:
        if POLICIES[policy] & r.mask:
            fails = F.expr(r.fails.replace("word_chars", "`_m`.word_chars").replace("n_", "`_m`.n_"))
            mask = mask.bitwiseOR(F.when(fails, F.lit(r.mask)).otherwise(F.lit(0)).cast("long"))
    judged = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), measured(docs["text"]).alias("_m"))
    return judged.filter(mask == 0).select("_row.*")


def ablation(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """By rule of a policy: documents it fails, and those that only it rejects. One row for each rule, from one count by mask."""
    by_mask = rows.groupBy(F.col("failed").bitwiseAND(F.lit(POLICIES[policy]).cast("long")).alias("mask")).agg(F.count(F.lit(1)).alias("n"))
    rules = [r for r in RULES if POLICIES[policy] & r.mask]
    each = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.mask).cast("long").alias("bit")) for r in rules])).alias("r")
    hit = F.when(F.col("mask").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)
    alone = F.when(F.col("mask") == F.col("r.bit"), F.col("n")).otherwise(0)
    return by_mask.select("mask", "n", each).groupBy(F.col("r.rule").alias("rule")).agg(F.sum(hit).alias("n_failed"), F.sum(alone).alias("n_only"))


def query(spark, sf_dir: str) -> DataFrame:
    from sievewell.llm.common import table

    rows = ledger(table(spark, sf_dir, "documents"))
    base = rejects("base-1")
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        (~(base | rejects(CURRENT))).alias("kept"), F.col("failed").alias("failed_rules"),
    )


#: Documents are numbered, for ids may repeat or be null.
ORACLE = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), toks AS (
  SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs
), wins AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM toks)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM wins) WHERE n > 1
), covered AS (
  SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest(range(i, i + 3)) AS j FROM twice) GROUP BY rid
), lines AS (
  SELECT rid, count(*) AS n, count(*) - count(DISTINCT line) AS again
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_upper,
    length(regexp_replace(text, '[^!]', '', 'g'))::BIGINT AS n_shouts,
    coalesce(lines.n, 0)::BIGINT AS n_lines, coalesce(lines.again, 0)::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM docs JOIN toks USING (rid) LEFT JOIN covered USING (rid) LEFT JOIN lines USING (rid)
), f AS (
  SELECT *, ({" + ".join(f"CASE WHEN {r.fails} THEN {r.mask} ELSE 0 END" for r in RULES)})::BIGINT AS failed_rules FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  failed_rules & {BASE} <> 0 AS base_failed, failed_rules & {POLICIES[CURRENT]} = 0 AS kept, failed_rules
FROM f"""
