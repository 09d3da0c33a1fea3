"""Text normalization and decoders of disguised text, as column functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Look-alike letters of other scripts and the Latin letters they are read as.
CYRILLIC_SMALL = ("авеһкмнорстухіј", "abehkmhopctyxij")
CYRILLIC_CAPITAL = ("АВЕКМНОРСТУХІЈ", "abekmhopctyxij")
GREEK_CAPITAL = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "abezhikmnoptyx")
GREEK_SMALL = ("αβεζηικμνορτυχ", "abezhikmvoptyx")
WIDE_DIGITS = ("０１２３４５６７８９", "0123456789")
HOMOGLYPHS = tuple("".join(x) for x in zip(CYRILLIC_SMALL, CYRILLIC_CAPITAL, GREEK_CAPITAL, GREEK_SMALL, WIDE_DIGITS, strict=True))
MORE_HOMOGLYPHS = ("εαορуѕ", "eaopys")
LEET = ("0134578@$", "oieastbas")
#: Zero-width characters, the soft hyphen, direction controls, variation selectors and tag characters.
INVISIBLE = r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}\x{AD}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{FE00}-\x{FE0F}\x{E0000}-\x{E007F}]"
WHITE = r"\p{Z}\t\n\x0b\x0c\r"


def homoglyph_fold(text: Column, table: tuple[str, str] = HOMOGLYPHS) -> Column:
    """Letters of the table as what they are read as. Texts without a letter beyond Latin skip the slow translation."""
    if not table[0]:
        return text
    folded = F.translate(text, *table)
    return F.when(text.rlike(r"[^\x00-\x{24F}]"), folded).otherwise(text) if min(map(ord, table[0])) > 0x24F else folded


def small_batches(rows: int = 1000, size: int = 4 << 20) -> None:
    """Keeps what a task hands to Python at a time to `rows` rows and about `size` bytes, whatever the table, as texts can be long.

    These are settings of the session, read when a result is computed, and so they stay set; smaller ones are left as they are."""
    conf = SparkSession.active().conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        if not 0 < int(str(conf.get(key)).rstrip("bB")) <= most:
            conf.set(key, str(most))


@F.pandas_udf(StringType())
def _folded(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None else t.lower() if t.isascii() else unicodedata.normalize("NFKC", t).casefold())


@F.pandas_udf(StringType())
def _unaccented(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def _beyond_ascii(text: Column, of, plain: Column) -> Column:
    """`of(text)` for texts with a character beyond ASCII, which alone leave the JVM; `plain` for the others."""
    small_batches()
    wide = text.rlike(r"[^\x00-\x7F]")
    return F.when(wide, of(F.when(wide, text))).otherwise(plain)


def normalize_text(text: Column, mode: str = "exact", table: tuple[str, str] = HOMOGLYPHS) -> Column:
    """NFKC, case folding and homoglyph folding, in this order.

    Mode "exact" runs the first two in an Arrow UDF, for texts beyond ASCII; "sql" is an approximation by lower case and
    ss for sharp s without NFKC: wide letters, mathematical letters and ligatures keep their form.
    """
    folded = _beyond_ascii(text, _folded, F.lower(text)) if mode == "exact" else F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    return homoglyph_fold(folded, table)


def strip_invisible(text: Column) -> Column:
    return F.regexp_replace(text, INVISIBLE, "")


def unaccent(text: Column) -> Column:
    return _beyond_ascii(text, _unaccented, text)


def leet_decode(text: Column) -> Column:
    return F.translate(text, *LEET)


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"[{WHITE}]+", " "))


def close_up(text: Column) -> Column:
    """Without single spaces between word characters: s p a c e d words are joined."""
    return F.regexp_replace(text, r"(?<=[\p{L}\p{N}_]) (?=[\p{L}\p{N}_])", "")


def decode_forms(text: Column, leet: bool = False) -> Column:
    """A struct of the decoded text as it is spaced, and closed up."""
    plain = F.translate(F.lower(unaccent(strip_invisible(text))), *MORE_HOMOGLYPHS)
    spaced = collapse_space(leet_decode(plain) if leet else plain)
    return F.struct(spaced.alias("spaced"), close_up(spaced).alias("closed"))


def triggered(forms: Column, triggers: Column, category: Column) -> Column:
    """Whether either form contains one of the triggers; never for category 0."""
    return (category != 0) & F.exists(triggers, lambda t: F.contains(forms["spaced"], t) | F.contains(forms["closed"], t))


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")
