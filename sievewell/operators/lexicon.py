"""Which lexicons a message contains a token of: by substring, one hit per lexicon, in lexicon order."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: So many tokens become literals of the plan; more are searched by an index, which is broadcast up to a number of tokens.
LITERAL_TOKENS, GRAM, MOST_BROADCAST, SALTS = 200, 4, 500_000, 16


@dataclass(frozen=True)
class Lexicon:
    lexicon_id: str
    category: int
    tokens: tuple[str, ...]
    weight: float = 0.6


def _usable(lexicons: Sequence[Lexicon]) -> list[tuple[int, Lexicon, list[str]]]:
    return [(i, x, [t.casefold() for t in x.tokens if t]) for i, x in enumerate(lexicons)]


def lexicon_hits(text: Column, lexicons: Sequence[Lexicon]) -> Column:
    """Array of (lexicon_id, category, weight) of the lexicons found in a normalized text."""
    entries = []
    for _, x, tokens in _usable(lexicons):
        found = F.lit(False)
        for t in tokens:
            found = found | F.contains(text, F.lit(t))
        entries.append(F.when(found, F.struct(F.lit(x.lexicon_id).alias("lexicon_id"), F.lit(x.category).alias("category"), F.lit(x.weight).alias("weight"))))
    empty = F.array().cast("array<struct<lexicon_id:string,category:int,weight:double>>")
    return F.filter(F.array(*entries), lambda h: h.isNotNull()) if entries else empty


def _small(texts: pa.Array, limit: int = 4 << 20) -> Iterator[list[str | None]]:
    """Texts a part of about `limit` bytes at a time; a longer one is a part of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
    place = (np.cumsum(sizes) - sizes) // limit
    for x in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(place)) + 1):
        if len(x):
            yield texts.slice(x[0], len(x)).to_pylist()


def _grams(text: str, lengths: Sequence[int]) -> set[str]:
    """The distinct runs of characters of the given lengths in a text."""
    return {text[i : i + q] for q in lengths for i in range(len(text) - q + 1)}


def _grams_of(lengths: Sequence[int]):
    @F.arrow_udf("array<string>")
    def grams(texts: pa.Array) -> pa.Array:
        parts = [pa.array([list(_grams(t, lengths)) if t else [] for t in part], pa.list_(pa.string())) for part in _small(texts)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))

    return grams


def _found_by(index: dict[str, list[tuple[str, int]]], lengths: Sequence[int]):
    """The numbers of the lexicons found in each text: its distinct grams that the index has, and of these the tokens that it holds."""

    @F.arrow_udf("array<int>")
    def found(texts: pa.Array) -> pa.Array:
        def one(t: str | None) -> list[int]:
            out: set[int] = set()
            for g in _grams(t, lengths) & index.keys() if t else ():
                for token, number in index[g]:
                    if number not in out and token in t:
                        out.add(number)
            return list(out)

        parts = [pa.array([one(t) for t in part], pa.list_(pa.int32())) for part in _small(texts)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return found


def token_table(spark, lexicons: Sequence[Lexicon]) -> DataFrame:
    """(position, lexicon_id, category, weight, token) of lexicons, tokens in lower case."""
    rows = [(i, x.lexicon_id, x.category, float(x.weight), t) for i, x, tokens in _usable(lexicons) for t in tokens]
    return spark.createDataFrame(rows, "position int, lexicon_id string, category int, weight double, token string")


def indexed(tokens: DataFrame, q: int = GRAM) -> DataFrame:
    """The rows of a token table with `gram`, the token's q-gram that the fewest tokens have; the whole token if it is shorter."""
    held = tokens.filter(F.length("token") > 0).withColumn("_q", F.least(F.length("token"), F.lit(q)))
    grams = held.select("token", "_q").distinct().select("token", F.explode(F.array_distinct(F.expr("transform(sequence(1, length(token) - _q + 1), i -> substring(token, i, _q))"))).alias("gram"))
    common = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = grams.join(common, "gram").groupBy("token").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    return held.drop("_q").join(rarest, "token")


def lexicon_search(messages: DataFrame, tokens: DataFrame, id_col: str = "msg_id", text_col: str = "norm", q: int = GRAM, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(id, lexicon_id, category, weight, position) of the lexicons found in normalized texts, for token tables of any size.

    Each token is filed under its rarest q-gram, and the distinct q-grams of a text, each once, are held against these
    by equality; only where they meet is the text searched for the whole token. Up to `most_broadcast` tokens the
    index goes to the tasks as a dictionary, texts are read once where they are and only numbers of lexicons leave them. Beyond, grams and index meet by gram and one of
    SALTS salts, so that no gram is one task's, without the texts; these are joined again by id, of which every text has its own.

    Null and empty texts and empty tokens give no rows; a lexicon is found once in a text. Rows with equal ids are one text
    for a large token table, and found apart, then made one, for a small one."""
    index = indexed(tokens, q)
    lengths = sorted(r[0] for r in index.select(F.length("gram")).distinct().collect())  # q numbers at most
    found = [id_col, "lexicon_id", "category", "weight", "position"]
    if not lengths:
        return messages.select(id_col).crossJoin(tokens.limit(0)).select(*found)
    texts = messages.select(id_col, text_col).filter(F.length(text_col) > 0)
    if index.limit(most_broadcast + 1).count() <= most_broadcast:
        rows = index.select("gram", "token", *found[1:]).collect()  # most_broadcast at most
        kinds = list(dict.fromkeys(tuple(r)[2:] for r in rows))
        number = {k: i for i, k in enumerate(kinds)}
        held: dict[str, list[tuple[str, int]]] = {}
        for r in rows:
            held.setdefault(r["gram"], []).append((r["token"], number[tuple(r)[2:]]))
        named = messages.sparkSession.createDataFrame([(i, *k) for i, k in enumerate(kinds)], StructType([StructField("_n", IntegerType()), *[index.schema[c] for c in found[1:]]]))
        hits = texts.select(id_col, F.explode(_found_by(held, lengths)(F.col(text_col))).alias("_n")).join(F.broadcast(named), "_n")
    else:
        grams = texts.select(id_col, F.explode(_grams_of(lengths)(F.col(text_col))).alias("gram"))
        salted = index.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = grams.select(id_col, "gram", F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int").alias("_salt")).join(salted, ["gram", "_salt"])
        hits = met.join(texts, id_col).filter(F.contains(F.col(text_col), F.col("token")))
    return hits.select(*found).distinct()


def lexicon_join(messages: DataFrame, lexicons: Sequence[Lexicon], id_col: str = "msg_id", text_col: str = "norm") -> DataFrame:
    """(id, lexicon_id, category, weight, position) rows: up to LITERAL_TOKENS tokens from literals of the plan, more by `lexicon_search`."""
    if sum(len(tokens) for _, _, tokens in _usable(lexicons)) > LITERAL_TOKENS:
        return lexicon_search(messages, token_table(messages.sparkSession, lexicons), id_col, text_col)
    each = [F.struct(F.contains(F.col(text_col), F.lit(t)).alias("found"), F.lit(x.lexicon_id).alias("lexicon_id"), F.lit(x.category).alias("category"), F.lit(float(x.weight)).alias("weight"), F.lit(i).alias("position"))
            for i, x, tokens in _usable(lexicons) for t in tokens]
    if not each:
        return lexicon_search(messages, token_table(messages.sparkSession, lexicons), id_col, text_col)
    hits = messages.select(id_col, F.explode(F.array_distinct(F.filter(F.array(*each), lambda h: h["found"]))).alias("h"))
    return hits.select(id_col, "h.lexicon_id", "h.category", "h.weight", "h.position").distinct()
