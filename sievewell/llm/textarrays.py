"""Words and shingles of many texts at once, as numpy arrays of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_R = 0x9E3779B97F4A7C15 | 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_LOW, _HIGH = _powers(_R, 1 << 12), _powers(pow(_R, 1 << 12, 1 << 64), 1 << 12)
_ORDER = _powers(0xD6E8FEB86659FD93, 64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case; all other bytes as they are."""
    return np.where((raw >= 65) & (raw <= 90), raw | 32, raw)


def word_hashes(texts: Sequence[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the words of text i are hashes[offsets[i] : offsets[i + 1]]; none for null."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(p) + 1 for p in parts], dtype=np.int64)
    raw = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    if lower:
        raw = lowered(raw)
    is_word = (raw != 32) & ((raw < 9) | (raw > 13))
    edge = np.diff(is_word.view(np.int8), prepend=np.int8(0))
    starts = np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(parts) + 1, np.int64)
    stops = np.flatnonzero(edge == -1)  # the last byte is white space
    lens = stops - starts
    at = np.flatnonzero(is_word)
    first = np.cumsum(lens) - lens
    rel = np.arange(len(at)) - np.repeat(first, lens)
    value = (raw[at].astype(np.uint64) + np.uint64(1)) * _LOW[rel & 0xFFF]
    if lens.max() > 1 << 12:
        value *= _HIGH[(rel >> 12) & 0xFFF]
    hashes = mixed(np.add.reduceat(value, first) + lens.astype(np.uint64))
    return hashes, np.concatenate([[0], np.searchsorted(starts, ends)])


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k words, at the run's first word."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out += hashes[i : i + n] * _ORDER[i + 1]
    return mixed(out)


def shingle_sets(texts: Sequence[str | None], k: int) -> Iterator[np.ndarray]:
    """For each text its distinct k-word shingles, sorted; the whole text as one if it has fewer words; none without words."""
    hashes, offsets = word_hashes(texts)
    runs = shingles(hashes, k)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= k:
            yield np.unique(runs[a : b - k + 1])
        elif b > a:
            yield shingles(hashes[a:b], int(b - a)) ^ np.uint64(b - a)
        else:
            yield np.zeros(0, np.uint64)


def by_bytes(texts: Sequence[str | None], limit: int = 1 << 20) -> Iterator[slice]:
    """Slices of `texts` of about `limit` characters each, so that arrays stay small; a longer text is a slice of its own."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > limit:
            yield slice(begin, i)
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield slice(begin, len(texts))
