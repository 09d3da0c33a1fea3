"""License scans by canonical digests.

A text is brought to a canonical form: lower case, copyright lines gone, equivalent spellings
made one, everything but letters and digits turned to single spaces. Its SHA-256 is joined by hash to
the digests of known licence texts in the same form. The entire text of a document is looked up,
and besides each entire line, as documents carry licence notices as lines of their own.

Known texts come as a table of (license_id, scope, text), scope `text` or `line`; NOTICES and `licensetexts` are
our own. Digests of 32 bytes are all that is joined; equal lines of a document count once.

Cases: null and empty texts, and texts of copyright lines alone, match nothing; a text equal to two
known ones gives a row for each; rows with equal ids are scanned one by one and give equal rows once;
a null doc_id keeps its rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewell.llm import licensetexts
from sievewell.llm.common import bind, table

#: Spellings held equal, as in published licence-matching guidelines; fixed values.
SAME = {"licence": "license", "licenced": "licensed", "licences": "licenses", "sublicence": "sublicense", "organisation": "organization", "favour": "favor", "honour": "honor", "whilst": "while", "per cent": "percent"}
VERSION = r" v (?=\d)"  # "v. 2.0" is "version 2.0"
MOST_BROADCAST = 100_000
COPYRIGHT = r"(?im)^[^\p{L}\p{N}\n]*(?:copyright|\(c\)|©|all rights reserved)[^\n]*$"
#: (license_id, scope, text): one-line notices, and short licences whole.
NOTICES = (
    ("GPL-3.0", "line", "This work is licensed under the GNU General Public License, version 3."),
    ("Apache-2.0", "line", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "line", "Released under the MIT License."),
    ("CC-BY-NC-4.0", "line", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "line", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "line", "Licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause", "line", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "line", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
)


def canonical(text: Column) -> Column:
    """The canonical form. Spellings are looked at only where one of them occurs, which prose seldom has."""

    def respelt(plain: Column) -> Column:
        out = F.regexp_replace(plain, VERSION, " version ")
        for a, b in SAME.items():
            out = F.regexp_replace(out, f" {a}(?= )", f" {b}")
        return F.when(plain.rlike(f" v \\d| ({'|'.join(SAME)}) "), out).otherwise(plain)

    plain = F.regexp_replace(F.lower(F.regexp_replace(text, COPYRIGHT, " ")), r"[^\p{L}\p{N}]+", " ")
    return F.trim(bind(F.concat(F.lit(" "), F.trim(plain), F.lit(" ")), respelt))


def digest(canon: Column) -> Column:
    return F.when(F.length(canon) > 0, F.sha2(canon, 256))


def known(spark: SparkSession, texts: DataFrame | None = None) -> DataFrame:
    """license_id, scope and digest of known licences: of `texts`, or of NOTICES and `licensetexts`."""
    own = texts is None
    if own:
        texts = spark.createDataFrame([*NOTICES, *licensetexts.TEXTS], "license_id string, scope string, text string")
    given = texts.select("license_id", "scope", digest(canonical(F.col("text"))).alias("digest")).filter(F.col("digest").isNotNull())
    if own:
        given = given.unionByName(spark.createDataFrame([(i, "text", d) for i, d in licensetexts.DIGESTS], "license_id string, scope string, digest string"))
    return given.distinct()


def scan(docs: DataFrame, licenses: DataFrame) -> DataFrame:
    """doc_id, license_id, scope and n_lines (of the text, equal to the licence) of each match."""
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("part"), F.lit("line").alias("scope"))
    whole = docs.select("doc_id", F.col("text").alias("part"), F.lit("text").alias("scope"))
    parts = lines.unionByName(whole).select("doc_id", "scope", digest(canonical(F.col("part"))).alias("digest"))
    if licenses.count() <= MOST_BROADCAST:  # beyond it the digests are shuffled, and the join splits those of common lines
        licenses = F.broadcast(licenses)
    hits = parts.join(licenses, ["scope", "digest"])
    return hits.groupBy("doc_id", "license_id", "scope").agg(F.count(F.lit(1)).alias("n_lines"))


def query(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), known(spark))


def _sql_canonical(text: str) -> str:
    """The same without lookahead: spaces are doubled, so that neighbours both match."""
    out = f"regexp_replace(lower(regexp_replace({text}, '{COPYRIGHT}', ' ', 'g')), '[^\\p{{L}}\\p{{N}}]+', '  ', 'g')"
    out = f"regexp_replace('  ' || trim({out}) || '  ', ' v  (\\d)', ' version  \\1', 'g')"
    for a, b in SAME.items():
        out = f"replace({out}, ' {a.replace(' ', '  ')} ', ' {b} ')"
    return f"trim(replace({out}, '  ', ' '))"


ORACLE = f"""
WITH known(license_id, scope, canon) AS (
  SELECT DISTINCT license_id, scope, {_sql_canonical('text')} FROM (VALUES {", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in row) + ")" for row in NOTICES)}) AS v(license_id, scope, text)
), parts AS (
  SELECT doc_id, 'line' AS scope, unnest(string_split(text, chr(10))) AS part FROM documents
  UNION ALL SELECT doc_id, 'text', text FROM documents
), forms AS (
  SELECT doc_id, scope, {_sql_canonical('part')} AS canon FROM parts WHERE part IS NOT NULL
)
SELECT doc_id, license_id, scope, count(*) AS n_lines FROM forms JOIN known USING (scope, canon) WHERE canon <> '' GROUP BY ALL"""
