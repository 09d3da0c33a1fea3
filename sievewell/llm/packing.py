"""Packing documents into training sequences, planned on the histogram of their lengths.

A document's ids, with the end id, are cut into pieces of `window`, and what is left of it
is its last piece. How many pieces there are of each length is all that the driver sees:
`window` numbers. From it:

1. Shallow combinations that fill a window are enumerated: two lengths, one length up to
   `depth` times with the rest of the window, and three lengths with the first two from a
   grid. How often to use each is a non-negative least squares problem against the
   histogram, solved by coordinate descent and rounded, never beyond what there is.
2. Pieces left over are packed greedily, the longest that fit first, and one piece is cut
   where a sequence would end short; what is cut off counts as a piece of its own length.
3. What can't fill a window, less than one in all, is cut into powers of two, which need
   no padding.

The plan gives intervals of pieces, in the order of each length, a sequence and an offset.
The order of pieces of a length is that of tasks and of pieces within a task, which is
written beside the ids, and so no length is gathered anywhere, however many pieces have it:
each task looks its own pieces up. A long text becomes rows of a window each.

Ids are those that the `tokenizers` library gives for the whole text, special tokens in it
included; `tiktoken` computes the same ids from the same vocabulary, at a quarter of the time.
It can't take very long runs of white space; texts with one go to `tokenizers`.
Only texts beyond SLICE characters are cut for it, before a single space between two characters
that aren't white space, where byte-level pre-tokenization always starts anew.

Cases: a null or empty text is the end id alone; repeated rows and ids, null ids too, are
documents of their own; an empty table gives no rows; other columns are ignored. Reruns over
the same files give the same pieces; the numbers of sequences may differ with the splits.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievewell.llm.common import small_batches, table, written

WINDOW, END, DEPTH, SWEEPS, GRID = 2048, 1, 8, 60, 64
SLICE, MOST_BROADCAST = 1 << 20, 500_000
_CUT, _WIDE = re.compile(r"(?<=\S) (?=\S)"), re.compile(r"\s{1000}")


def vocabulary(name: str = "byte_bpe_50k") -> tuple[str, bytes, str, dict[str, int]]:
    """(definition, ranks, pattern, special tokens): a public byte-level BPE for `tokenizers`, and the same for `tiktoken`."""
    import public_tokenizers as public

    with open(public.path(f"{name}.json")) as f, open(public.path(f"{name}.tiktoken"), "rb") as g:
        return f.read(), g.read(), public.PATTERN, {"<|endoftext|>": 50256}


class Encoder:
    """The ids of whole texts, little-endian and of one size."""

    def __init__(self, definition: str, ranks: bytes, pattern: str, special: dict[str, int]):
        import tiktoken

        self.definition, self.slow = definition, None
        of = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.special = special
        self.tokenizer = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=of, special_tokens=special)
        self.kind = np.dtype("<u2") if self.tokenizer.n_vocab <= 1 << 16 else np.dtype("<u4")

    def _slow(self, text: str) -> list[int]:
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_str(self.definition)
        return self.slow.encode(text, add_special_tokens=False).ids

    def slices(self, text: str) -> Iterator[bytes]:
        """The ids of a text, so many at a time."""
        begin = 0
        while begin < len(text):
            cut = _CUT.search(text, begin + SLICE) if len(text) - begin > SLICE else None
            end = cut.start() if cut else len(text)
            part = text[begin:end] if end - begin < len(text) else text
            if _WIDE.search(part):
                ids = self._slow(part)
            elif any(s in part for s in self.special):
                ids = self.tokenizer.encode(part, allowed_special="all")
            else:
                ids = self.tokenizer.encode_ordinary(part)
            yield np.array(ids, self.kind).tobytes()
            begin = end


def tokenized(docs: DataFrame, tokenizer: tuple[str, bytes, str, dict[str, int]], window: int = WINDOW, end: int = END) -> DataFrame:
    """A row for each piece: doc_id, start, length, doc_tokens, ids, and its place, the nth of its length in task `pid`."""
    small_batches()
    names = ["doc_id", "start", "length", "doc_tokens", "ids", "pid", "nth"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pid, seen = Encoder(*tokenizer), TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        step, last = window * encoder.kind.itemsize, np.array([end], encoder.kind).tobytes()
        rows, held = [[] for _ in range(5)], 0

        def out() -> pa.RecordBatch:
            doc, starts, lengths, totals, ids = rows
            nth = np.zeros(len(lengths), np.int64)
            for i, n in enumerate(lengths):
                nth[i] = seen[n]
                seen[n] += 1
            columns = [pa.array(doc, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int32()), pa.array(totals, pa.int64())]
            columns += [pa.array(ids, pa.binary()), pa.array([pid] * len(doc), pa.int32()), pa.array(nth)]
            for r in rows:
                r.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                raw = b"".join(encoder.slices(text or "")) + last
                total = len(raw) // encoder.kind.itemsize
                for at in range(0, len(raw), step):
                    ids = raw[at : at + step]
                    for r, x in zip(rows, (doc, at // encoder.kind.itemsize, len(ids) // encoder.kind.itemsize, total, ids)):
                        r.append(x)
                    held += len(ids)
                    if held > 8 << 20:
                        yield out()
                        held = 0
        yield out()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(work, "doc_id long, start long, length int, doc_tokens long, ids binary, pid int, nth long")


# The plan, on the driver: nothing in it grows with the number of pieces.


def combinations(lengths: np.ndarray, window: int, depth: int = DEPTH, grid: int = GRID) -> list[dict[int, int]]:
    """Multisets of the given lengths that sum to `window`, of at most `depth` pieces."""
    there, out = set(lengths.tolist()), set()
    if window in there:
        out.add((window,))
    for a in there:
        for k in range(1, depth):
            rest = window - k * a
            if rest == 0:
                out.add((a,) * k)
            elif rest > 0 and rest in there:
                out.add(tuple(sorted([a] * k + [rest])))
    some = lengths[:: max(1, len(lengths) // grid)].tolist()
    for i, a in enumerate(some):
        for b in some[i + 1 :]:
            if window - a - b in there:
                out.add(tuple(sorted((a, b, window - a - b))))
    return [{n: c.count(n) for n in c} for c in sorted(out)]


def repeats(columns: list[dict[int, int]], histogram: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """x >= 0 that brings the columns' sum nearest to the histogram in the least squares sense, by coordinate descent."""
    rest = histogram.astype(float).tolist()
    x, cols = [0.0] * len(columns), [(list(c.items()), sum(n * n for n in c.values())) for c in columns]
    for _ in range(sweeps):
        most = 0.0
        for j, (col, square) in enumerate(cols):
            gain = 0.0
            for i, n in col:
                gain += n * rest[i]
            step = max(-x[j], gain / square)
            if step:
                x[j] += step
                for i, n in col:
                    rest[i] -= n * step
                most = max(most, abs(step))
        if most < 0.25:  # nothing that rounding would keep
            break
    return np.array(x)


@dataclass
class Block:
    """Pieces `rank` to `rank + count` of length `origin`, from their id `begin` on."""

    origin: int
    rank: int
    count: int
    begin: int


def plan(histogram: np.ndarray, window: int = WINDOW, depth: int = DEPTH) -> np.ndarray:
    """Rows (origin, begin, rank, count, length, sequence, offset): pieces rank + i have their ids from begin on, `length` of them, in sequence + i."""
    left = histogram.astype(np.int64).copy()
    queues: dict[int, deque[Block]] = defaultdict(deque)
    for n in np.flatnonzero(left):
        queues[int(n)].append(Block(int(n), 0, int(left[n]), 0))
    rows: list[tuple[int, ...]] = []
    sequence = 0

    def take(length: int, count: int, used: int, first: int, offset: int) -> list[tuple[int, Block]]:
        """Places `used` ids of `count` pieces of a length into sequences from `first` on; returns what is cut off them."""
        cut = []
        while count:
            block = queues[length][0]
            n = min(count, block.count)
            rows.append((block.origin, block.begin, block.rank, n, used, first, offset))
            if used < length:
                cut.append((length - used, Block(block.origin, block.rank, n, block.begin + used)))
            block.rank, block.count = block.rank + n, block.count - n
            if not block.count:
                queues[length].popleft()
            left[length] -= n
            first, count = first + n, count - n
        return cut

    def fill(times: int, uses: list[tuple[int, int]], cut: tuple[int, int] | None = None) -> None:
        nonlocal sequence
        offset = 0
        for length, n in uses:
            for _ in range(n):
                take(length, times, length, sequence, offset)
                offset += length
        for rest, block in take(cut[0], times, cut[1], sequence, offset) if cut else []:
            queues[rest].append(block)
            left[rest] += block.count
        sequence += times

    columns = combinations(np.flatnonzero(left), window, depth)
    wanted = np.rint(repeats(columns, left)).astype(np.int64)
    for j in np.argsort(-wanted, kind="stable"):
        times = min([int(wanted[j]), *(int(left[n]) // k for n, k in columns[j].items())])
        if times > 0:
            fill(times, sorted(columns[j].items(), reverse=True))
    total = int((left * np.arange(len(left))).sum())
    while total >= window:
        space, uses = window, []
        for n in np.flatnonzero(left)[::-1].tolist():
            if n <= space:
                k = min(int(left[n]), space // n)
                uses.append((n, k))
                space -= n * k
                if not space:
                    break
        used, cut = dict(uses), None
        if space:
            longer = [n for n in np.flatnonzero(left).tolist() if n > space and left[n] > used.get(n, 0)]
            cut = (longer[0], space)
            used[cut[0]] = used.get(cut[0], 0) + 1
        times = min(int(left[n]) // k for n, k in used.items())
        fill(times, uses, cut)
        total -= times * window
    power = 1 << max(0, window.bit_length() - 1)
    while total:  # less than a window
        while power > total:
            power >>= 1
        offset = 0
        while offset < power:
            n = int(np.flatnonzero(left)[-1])
            used = min(n, power - offset)
            for rest, block in take(n, 1, used, sequence, offset):
                queues[rest].append(block)
                left[rest] += 1
            offset += used
        sequence, total = sequence + 1, total - power
    return np.array(rows, np.int64).reshape(-1, 7)


def pack(docs: DataFrame, tokenizer: tuple[str, bytes, str, dict[str, int]], window: int = WINDOW, end: int = END) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids (binary), doc_tokens, sequence_id and offset. `tokenizer` is what `vocabulary` gives."""
    pieces = written(tokenized(docs, tokenizer, window, end), "pack-pieces")
    kind = "<u2" if Encoder(*tokenizer).kind.itemsize == 2 else "<u4"
    counts = pieces.groupBy("pid", "length").count()
    base = F.sum("count").over(Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("count")
    bases = written(counts.withColumn("base", base), "pack-bases")
    histogram = np.zeros(window + 1, np.int64)
    for r in bases.groupBy("length").agg(F.sum("count").alias("n")).collect():  # `window` rows at most
        histogram[r["length"]] = r["n"]
    table_ = plan(histogram, window)
    table_ = table_[np.lexsort((table_[:, 2], table_[:, 1], table_[:, 0]))]
    key = (table_[:, 0] * (window + 1) + table_[:, 1]).astype(np.int64)  # origin and begin; ranks ascend within
    firsts = {int(k): (int(i), int(j)) for k, i, j in zip(*_runs_of(key))}
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = np.dtype(kind).itemsize
        for batch in batches:
            length, rank = batch.column("length").to_numpy().astype(np.int64), batch.column("nth").to_numpy() + batch.column("base").to_numpy()
            start, ids = batch.column("start").to_numpy(), batch.column("ids").to_pylist()
            at, begin, out = np.arange(len(batch)), np.zeros(len(batch), np.int64), []
            while len(at):  # once more for each cut
                where, found = length[at] * (window + 1) + begin, np.zeros(len(at), np.int64)
                for k in np.unique(where):
                    i, j = firsts[int(k)]
                    own = where == k
                    found[own] = i + np.searchsorted(table_[i:j, 2], rank[at[own]], "right") - 1
                row = table_[found]
                out.append((at, begin, row[:, 4], row[:, 5] + rank[at] - row[:, 2], row[:, 6]))
                more = begin + row[:, 4] < length[at]
                at, begin = at[more], (begin + row[:, 4])[more]
            at, begin, used, sequence, offset = (np.concatenate(c) for c in zip(*out))
            own = [ids[i][b * size : (b + n) * size] for i, b, n in zip(at.tolist(), begin.tolist(), used.tolist())]
            columns = [batch.column("doc_id").take(pa.array(at)), pa.array(start[at] + begin), pa.array(used), pa.array(own, pa.binary())]
            columns += [batch.column("doc_tokens").take(pa.array(at)), pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names)

    placed = bases.select("pid", "length", "base")
    if bases.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        placed = F.broadcast(placed)
    joined = pieces.join(placed, ["pid", "length"]).select("doc_id", "start", "length", "ids", "doc_tokens", "nth", "base")
    return joined.mapInArrow(work, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def _runs_of(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.diff(sorted_keys, prepend=-1))
    return sorted_keys[first], first, np.append(first[1:], len(sorted_keys))


def query(spark, sf_dir: str) -> DataFrame:
    """Pieces with the CRC of their ids as unsigned 32-bit numbers."""
    tokenizer = vocabulary()
    kind = Encoder(*tokenizer).kind.str

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = [zlib.crc32(np.frombuffer(i, kind).astype("<u4").tobytes()) for i in batch.column("ids").to_pylist()]
            at = batch.schema.get_field_index("ids")
            yield batch.set_column(at, "ids_crc32", pa.array(crc, pa.int64()))

    packed = pack(table(spark, sf_dir, "documents"), tokenizer)
    return packed.mapInArrow(work, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
