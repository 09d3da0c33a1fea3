"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are cut into windows of WINDOW bytes. The network reads each window in both
directions and gives every position language probabilities; the probabilities of all
letter positions of the whole text are averaged. It is trained here, in numpy, by
backpropagation through time, on a bounded sample: at most `per_lang` documents of each
language and `windows` windows of each document. That sample is all that reaches the driver.

Cases: a null text, or one without a letter, is `und` with score 0; rows with equal ids
are judged one by one; null languages and null ids are never learned from; without any
row to learn from, every text is `und`; other columns of the input are left as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievewell.llm.common import small_batches, table
from sievewell.llm.textarrays import by_bytes, lowered

WINDOW = 64
HIDDEN = 6
UNKNOWN = "und"
BLOCK = 1024  # windows at a time
_LETTERS = np.array([97 <= i <= 122 or i >= 0xC2 for i in range(256)])  # after lowering: a-z, or the first byte of a character outside ASCII


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    weights: dict[str, np.ndarray]  # E, U, c for forward (f) and backward (b); V, d for the labels


def _start(n_langs: int, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    w = {}
    for side in "fb":
        w["E" + side] = rng.normal(0, 0.3, (3 * HIDDEN, 256))
        w["U" + side] = rng.normal(0, 1 / np.sqrt(HIDDEN), (3 * HIDDEN, HIDDEN))
        w["c" + side] = np.zeros((HIDDEN, 1))
        w["E" + side][HIDDEN : 2 * HIDDEN] += 1  # update gates start by keeping the state
    w["V"] = rng.normal(0, 0.3, (n_langs, 2 * HIDDEN))
    w["d"] = np.zeros((n_langs, 1))
    return {k: v.astype(np.float32) for k, v in w.items()}


def _states(w: dict, side: str, windows: np.ndarray, saved: list | None = None) -> np.ndarray:
    """States of one direction for windows (steps, n): an array (steps, HIDDEN, n), in the order of the text."""
    e, u, c, (steps, n) = w["E" + side], w["U" + side], w["c" + side], windows.shape
    h, out = np.zeros((HIDDEN, n), np.float32), np.empty((steps, HIDDEN, n), np.float32)
    x, a = np.empty((3 * HIDDEN, n), np.float32), np.empty((3 * HIDDEN, n), np.float32)
    for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
        np.take(e, windows[t], axis=1, out=x, mode="clip")
        np.matmul(u, h, out=a)
        gates, new = a[: 2 * HIDDEN], a[2 * HIDDEN :]
        gates += x[: 2 * HIDDEN]
        np.negative(gates, out=gates)
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        new += c
        inner = new.copy() if saved is not None else None
        new *= gates[:HIDDEN]
        new += x[2 * HIDDEN :]
        np.tanh(new, out=new)
        if saved is not None:
            saved.append((t, h.copy(), gates.copy(), inner, new.copy()))
        h -= new
        h *= gates[HIDDEN:]
        h += new
        out[t] = h
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def _position_probs(w: dict, windows: np.ndarray) -> np.ndarray:
    """(steps, languages, n): the label probabilities of every position."""
    both = np.concatenate([_states(w, "f", windows), _states(w, "b", windows)], axis=1)
    return _softmax(w["V"] @ both + w["d"])


def _gradients(w: dict, windows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross-entropy over letter positions, by backpropagation through time."""
    steps, n = windows.shape
    kept = {"f": [], "b": []}
    both = np.concatenate([_states(w, s, windows, kept[s]) for s in "fb"], axis=1)
    p = _softmax(w["V"] @ both + w["d"])
    p[:, labels, np.arange(n)] -= 1
    mask = _LETTERS[windows].astype(np.float32)
    p *= (mask / max(1.0, mask.sum()))[:, None, :]
    g = {"V": np.einsum("tln,thn->lh", p, both, optimize=True), "d": p.sum(axis=(0, 2))[:, None]}
    down = w["V"].T @ p
    for i, side in enumerate("fb"):
        u, dh = w["U" + side], np.zeros((HIDDEN, n), np.float32)
        gu, ge, gc = np.zeros_like(u), np.zeros((3 * HIDDEN, 256), np.float32), np.zeros((HIDDEN, 1), np.float32)
        for t, h, gates, inner, new in reversed(kept[side]):
            r, z = gates[:HIDDEN], gates[HIDDEN:]
            dh = dh + down[t, i * HIDDEN : (i + 1) * HIDDEN]
            dnew = dh * (1 - z) * (1 - new * new)
            da = np.concatenate([dnew * inner * r * (1 - r), dh * (h - new) * z * (1 - z), dnew])
            for row in range(3 * HIDDEN):
                ge[row] += np.bincount(windows[t], weights=da[row], minlength=256)
            du = np.concatenate([da[: 2 * HIDDEN], dnew * r])
            gc += du[2 * HIDDEN :].sum(axis=1, keepdims=True)
            gu += du @ h.T
            dh = dh * z + u.T @ du
        g |= {"U" + side: gu, "E" + side: ge, "c" + side: gc}
    return g


def train(windows: np.ndarray, labels: np.ndarray, n_langs: int, epochs: int = 6, batch: int = 256, rate: float = 0.02, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights learned by Adam from windows (n, WINDOW) and their languages' numbers."""
    w, rng = _start(n_langs, seed), np.random.default_rng(seed)
    m, v, step = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0
    total = epochs * -(-len(windows) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            g = _gradients(w, np.ascontiguousarray(windows[part].T).astype(np.intp), labels[part])
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            step += 1
            now = rate * (1 - 0.9 * step / total)
            for k in w:
                x = g[k] * min(1.0, 1.0 / max(norm, 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.99 * v[k] + 0.01 * x * x
                w[k] = (w[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return w


def cut(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(windows, first): windows (n, WINDOW) of lowered bytes, the last of a text filled with zeros; those of text i are first[i] : first[i + 1]."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    first = np.concatenate([[0], np.cumsum([-(-len(p) // WINDOW) for p in parts])]).astype(np.int64)
    flat = np.zeros(first[-1] * WINDOW, np.uint8)
    for p, at in zip(parts, first[:-1] * WINDOW, strict=True):
        flat[at : at + len(p)] = np.frombuffer(p, np.uint8)
    return lowered(flat).reshape(-1, WINDOW), first


def document_probs(w: dict[str, np.ndarray], texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(probs, letters): mean language probabilities over the letter positions of each whole text, and how many there are."""
    windows, first = cut(texts)
    n_langs = len(w["d"])
    sums = np.zeros((len(windows) + 1, n_langs + 1))
    for at in range(0, len(windows), BLOCK):
        part = np.ascontiguousarray(windows[at : at + BLOCK].T).astype(np.intp)
        mask = _LETTERS[part].astype(np.float32)
        sums[at : at + part.shape[1], :n_langs] = np.einsum("tln,tn->nl", _position_probs(w, part), mask)
        sums[at : at + part.shape[1], n_langs] = mask.sum(axis=0)
    whole = np.add.reduceat(sums, first[:-1], axis=0) if len(texts) else sums[:0]
    whole[first[:-1] == first[1:]] = 0
    letters = whole[:, n_langs]
    return whole[:, :n_langs] / np.maximum(letters, 1)[:, None], letters


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit(docs: DataFrame, may_learn: Column, per_lang: int = 300, windows: int = 8, salts: int = 64) -> Model:
    """Learns from the rows of `docs` where `may_learn` holds: of each language the `per_lang` documents whose ids hash lowest,
    and of each of these `windows` windows spread over its whole text."""
    small_batches()
    spark = docs.sparkSession
    key = F.xxhash64("doc_id")
    # windows by language and salt first, so that no task gets all rows of a language
    able = docs.filter(may_learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("lang", "doc_id", key.alias("k")).distinct()
    for by in (["lang", F.pmod("k", F.lit(salts))], ["lang"]):
        place = F.row_number().over(Window.partitionBy(*by).orderBy("k", "doc_id"))
        able = able.withColumn("place", place).filter(F.col("place") <= per_lang).drop("place")
    chosen = able.collect()  # per_lang rows a language
    if not chosen:
        return Model((), {})
    langs = tuple(sorted({r["lang"] for r in chosen}))
    ids = spark.createDataFrame(sorted({(r["doc_id"],) for r in chosen}), "doc_id long")
    texts = docs.filter(may_learn & F.col("lang").isNotNull()).join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", "lang", "text")

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, lang, text in zip(pdf["doc_id"], pdf["lang"], pdf["text"], strict=True):
                got, _ = cut([text])
                for i in sorted(set(np.linspace(0, max(0, len(got) - 1), windows).astype(int))) if len(got) else ():
                    rows.append((doc, lang, int(i), got[i].tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "lang", "i", "bytes"])

    once = texts.mapInPandas(spread, "doc_id long, lang string, i int, bytes binary").groupBy("doc_id", "lang", "i").agg(F.min("bytes").alias("bytes"))
    rows = once.toPandas().sort_values(["doc_id", "lang", "i"])  # of a bounded sample, however often an id occurs
    if not len(rows):
        return Model((), {})
    data = np.frombuffer(b"".join(rows["bytes"]), np.uint8).reshape(-1, WINDOW)
    number = {x: i for i, x in enumerate(langs)}
    labels = rows["lang"].map(number).to_numpy()
    return Model(langs, train(data, labels, len(langs)))


def predicted(model: Model, text: Column) -> Column:
    """A struct of lang_pred and score for each text."""
    small_batches()

    @F.pandas_udf("lang_pred string, score double")
    def judge(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            texts, out = s.tolist(), []
            for at in by_bytes(texts):
                if model.langs:
                    p, letters = document_probs(model.weights, texts[at])
                    out += [(model.langs[i], float(x)) if n else (UNKNOWN, 0.0) for i, x, n in zip(p.argmax(axis=1), p.max(axis=1), letters, strict=True)]
                else:
                    out += [(UNKNOWN, 0.0)] * (at.stop - at.start)
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    got = judge(text)
    return F.when(has_letter(text), got).otherwise(F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score")))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def accepted(docs: DataFrame, model: Model, min_score: float = 0.35) -> DataFrame:
    """The rows of `docs` whose language is known with at least `min_score`, with all their columns."""
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    judged = docs.select(row.alias("_row"), predicted(model, docs["text"]).alias("_p"))
    return judged.filter((F.col("_p.lang_pred") != UNKNOWN) & (F.col("_p.score") >= min_score)).select("_row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, ~held_out())
    judged = docs.select("doc_id", predicted(model, F.col("text")).alias("p"))
    return judged.select("doc_id", held_out().alias("held_out"), "p.lang_pred", "p.score")
