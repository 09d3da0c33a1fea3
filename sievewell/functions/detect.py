"""Rule detectors on normalized text: links, personal data, scam phrasing, media, context."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievewell.functions.text import WHITE

_NW, _NL = r"[^\p{L}\p{N}_]", r"[^\p{L}\p{N}_\n]"
URL = rf"(?i)(?:https?://|www\.)[^<>\"'{WHITE}]{{3,}}"
EMAIL = r"[\p{L}\p{N}_.+\-]+@[\p{L}\p{N}_\-]+\.[\p{L}\p{N}_.\-]+"
PHONE = rf"(^|{_NW})\+?\p{{Nd}}[\p{{Nd}}\-{WHITE}().]{{7,}}\p{{Nd}}($|{_NW})"
CARD = r"(^|[^\p{Nd}])(\p{Nd}[ \-]?){13,19}($|[^\p{Nd}])"
FEE = rf"(?i)(^|{_NW})(wire|transfer|deposit)({_NL}|{_NL}[^\n]*{_NL})(fee)($|{_NW})"
PRIZE = rf"(?i)(^|{_NW})(congratulations|you[{WHITE}]+(have[{WHITE}]+)?won|claim[{WHITE}]+your[{WHITE}]+prize)($|{_NW})"
LOGIN = rf"(?i)(^|{_NW})(verify|confirm|reset|update)({_NL}|{_NL}[^\n]*{_NL})(password|account|login)($|{_NW})"
# Fixed values.
PII = {"EMAIL": EMAIL, "PHONE": PHONE, "CREDIT_CARD": CARD}
SCAM = {"ADVANCE_FEE": FEE, "FAKE_GIVEAWAY": PRIZE, "CREDENTIAL_HARVEST": LOGIN}
RISKY_TLDS = ("zip", "mov", "top", "click", "country", "xyz")
RISKY_WORDS = ("login", "verify", "account", "secure", "update")
CONTEXTS = {
    "NEWS_CONTEXT": ("journalism", "news"),
    "EDUCATION_CONTEXT": ("education_higher", "education", "school", "research", "science"),
    "COUNTERSPEECH_CONTEXT": ("lgbtq_support", "minority_support", "civic", "humanrights"),
}
CONTEXT_CONFIDENCE, QUOTE_CONFIDENCE, OTHER_CONFIDENCE = 0.5, 0.7, 0.3


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(URL), F.lit(0))


def url_risk(text: Column) -> Column:
    """The highest risk of the links in a text; 0 without a link."""

    def risk(u: Column) -> Column:
        low = F.lower(u)
        tld = _any([low.endswith(f".{t}") | low.contains(f".{t}/") for t in RISKY_TLDS])
        word = _any([low.contains(w) for w in RISKY_WORDS])
        return F.when(tld, F.lit(0.9)).when(word, F.lit(0.85)).otherwise(F.lit(0.2))

    return F.coalesce(F.array_max(F.transform(urls(text), risk)), F.lit(0.0))


#: What every match of a pattern contains; looked for first, as it is found fast and seldom there.
_NEEDS = {"EMAIL": "@", "PHONE": r"\p{Nd}", "CREDIT_CARD": r"\p{Nd}", "ADVANCE_FEE": "(?i)fee", "FAKE_GIVEAWAY": "(?i)congratulations|won|prize", "CREDENTIAL_HARVEST": "(?i)password|account|login"}


def _named(text: Column, patterns: dict[str, str]) -> Column:
    hits = F.array(*[F.when(text.rlike(_NEEDS[n]) & text.rlike(p), F.lit(n)) for n, p in patterns.items()])
    return F.coalesce(F.filter(hits, lambda x: x.isNotNull()), F.array().cast("array<string>"))


def pii_hits(text: Column) -> Column:
    return _named(text, PII)


def scam_hits(text: Column) -> Column:
    return _named(text, SCAM)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def media(items: Column) -> Column:
    """Media descriptions with kinds filled in and scores brought to [0, 1]; none for null."""

    def one(m: Column) -> Column:
        return F.struct(
            F.coalesce(m["kind"], F.lit("image")).alias("kind"), clamp(m["nsfw_score"]).alias("nsfw_score"), clamp(m["violence_score"]).alias("violence_score"),
            F.when(m["face_count"].isNotNull(), F.greatest(F.lit(0), m["face_count"])).alias("face_count"))

    return F.coalesce(F.transform(items, one), F.array().cast("array<struct<kind:string,nsfw_score:double,violence_score:double,face_count:int>>"))


def context_hints(overlay: Column, quoted: Column) -> Column:
    """Codes of protected contexts and their confidences, as an array of structs in fixed order."""
    low = F.lower(F.coalesce(overlay, F.lit("")))
    hints = [F.when(_any([low.contains(t) for t in tokens]), F.struct(F.lit(code).alias("code"), F.lit(CONTEXT_CONFIDENCE).alias("confidence"))) for code, tokens in CONTEXTS.items()]
    hints.append(F.when(F.coalesce(quoted, F.lit(False)), F.struct(F.lit("QUOTED_SPEECH_CONTEXT").alias("code"), F.lit(QUOTE_CONFIDENCE).alias("confidence"))))
    return F.filter(F.array(*hints), lambda h: h.isNotNull())


class Registry:
    """Detectors by kind. What a caller registers stands in for the built-in of that kind."""

    BUILT_IN: dict[str, Callable[..., Column]] = {"url_risk": url_risk, "pii": pii_hits, "scam": scam_hits, "context_hints": context_hints, "media": media}

    def __init__(self, **own: Callable[..., Column]):
        self._own = dict(own)

    def register(self, kind: str, detector: Callable[..., Column]) -> None:
        self._own[kind] = detector

    def get(self, kind: str) -> Callable[..., Column]:
        return self._own.get(kind) or self.BUILT_IN[kind]

    def kinds(self) -> list[str]:
        return sorted({*self._own, *self.BUILT_IN})
