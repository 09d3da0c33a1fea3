"""Packing: every id in one piece, sequences without gaps, and hardly any padding."""

import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sievewell.llm import packing


@pytest.fixture(scope="module")
def definition():
    return packing.vocabulary()


def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def whole():
    held = tokenizer()
    return lambda text: held.encode(text or "", add_special_tokens=False).ids


def padding(lengths, window):
    return sum(0 if n & (n - 1) == 0 else window - n for n in lengths)


def check(rows, texts, whole, window):
    """Rows of `pack` for documents with the given ids; returns the lengths of sequences."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u2").tolist()
        assert len(ids) == r["length"] > 0
        docs[r["doc_id"]].append((r["start"], ids, r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(docs) == set(texts)
    for doc, pieces in docs.items():
        want, at = [*whole(texts[doc]), packing.END], 0
        for start, ids, total in sorted(pieces):
            assert start == at and total == len(want) and want[start : start + len(ids)] == ids
            at += len(ids)
        assert at == len(want)
    lengths = []
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
        lengths.append(at)
    assert sorted(sequences) == list(range(len(sequences)))
    return lengths


def test_texts_of_all_kinds(spark, definition, whole):
    r = random.Random(5)
    words = ["the", "don't", "naïve", "\n\n", "日本語", " two", "x" * 90, "<|endoftext|>", "3.14", "\t", "a  b", " ", "  y", "emoji😀", "'s"]
    texts = {i: " ".join(r.choices(words, k=r.randint(0, 60))) for i in range(150)}
    texts |= {500: None, 501: "", 502: " ", 503: "word " * 9000, 504: "\n", 505: " a ", 506: "z" * 5000, 507: texts[3], 508: "\x1c a \x85 b"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("ids", packing.F.lit(1)).withColumn("pid", packing.F.lit(2))
    for window in (2048, 100):
        got = packing.pack(docs.repartition(7), definition, window).collect()
        assert padding(check(got, texts, whole, window), window) == 0


def test_repeated_rows_one_hot_length_and_nothing(spark, definition):
    docs = spark.createDataFrame([(1, "same text")] * 500 + [(None, "x")] * 3 + [(7, None)] * 40, "doc_id long, text string")
    got = packing.pack(docs, definition, 64).collect()
    per = defaultdict(int)
    for r in got:
        per[r["doc_id"]] += r["length"]
    assert per == {1: 500 * 3, None: 6, 7: 40}
    assert packing.pack(docs.limit(0), definition).count() == 0


def test_slices_of_a_long_text(definition, whole, monkeypatch):
    monkeypatch.setattr(packing, "SLICE", 50)
    text = "some words, and  double spaces\n then lines \n\n of any length; don't stop here " * 20
    assert np.frombuffer(b"".join(packing.Encoder(*definition).slices(text)), "<u2").tolist() == whole(text)


_OWN, _THEIRS = packing.Encoder(*packing.vocabulary()), tokenizer()


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(alphabet="aB 1'.\n\té日 \u00a0\x1c\u2003", max_size=60), st.text(max_size=60)))
def test_ids_are_those_of_the_tokenizers_library(text):
    assert np.frombuffer(b"".join(_OWN.slices(text)), "<u2").tolist() == _THEIRS.encode(text, add_special_tokens=False).ids


def test_ids_of_all_the_documents_of_a_table(spark):
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    for text, theirs in zip(texts, _THEIRS.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(b"".join(_OWN.slices(text)), "<u2").tolist() == theirs.ids


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 300_000 + "a", "z" * 300_000, "日" * 100_000, "!" * 300_000], ids=["spaces", "lines", "letters", "han", "marks"])
def test_long_runs(text):
    assert np.frombuffer(b"".join(_OWN.slices(text)), "<u2").tolist() == _THEIRS.encode(text, add_special_tokens=False).ids


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 200), max_size=32))
def test_plan_places_every_id_once(counts):
    histogram = np.zeros(33, np.int64)
    for n, c in counts.items():
        histogram[n] = c
    rows = packing.plan(histogram, 32)
    seen, used = defaultdict(list), defaultdict(list)
    for origin, begin, rank, count, length, sequence, offset in rows.tolist():
        for i in range(count):
            seen[origin, rank + i].append((begin, length))
            used[sequence + i].append((offset, length))
    assert len(seen) == histogram.sum()
    for (origin, _), pieces in seen.items():
        at = 0
        for begin, length in sorted(pieces):
            assert begin == at
            at += length
        assert at == origin
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 32 or at & (at - 1) == 0


def test_least_squares_against_an_exact_case():
    """Two columns that meet the histogram exactly, and one that must stay at zero."""
    histogram = np.zeros(11, np.int64)
    histogram[[3, 7, 4, 6]] = [50, 50, 20, 20]
    columns = [{3: 1, 7: 1}, {4: 1, 6: 1}, {3: 2, 4: 1}]
    x = packing.repeats(columns, histogram, 500)
    assert np.allclose(x[:2], [50, 20], atol=1) and x[2] < 1


def test_documents_of_a_normal_spread_are_rarely_cut():
    r = np.random.default_rng(7)
    histogram = np.bincount(np.clip(r.lognormal(6, 0.8, 200_000).astype(int), 1, 2048), minlength=2049)
    rows = packing.plan(histogram)
    cut = rows[rows[:, 1] > 0, 3].sum()
    assert cut < 0.1 * histogram.sum()
