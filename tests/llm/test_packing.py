import string
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spectrail.llm import packing


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=200), st.sampled_from([60, 64, 100]))
def test_places_fill_bins_without_gaps(items, capacity):
    rows = packing.places(dict(Counter(items)), capacity)
    bins, seen = {}, set()
    for length, rank, n, per_bin, first, offset in rows:
        for j in range(n):
            assert (length, rank + j) not in seen
            seen.add((length, rank + j))
            bins.setdefault(first + j // per_bin, []).append((offset + j % per_bin * length, length))
    assert Counter(length for length, _ in seen) == Counter(items)
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity


def test_places_do_not_grow_with_the_items():
    counts = {k: 3 + k % 5 for k in range(1, 2049)}
    few = packing.places(counts)
    many = packing.places({k: 1000 * n for k, n in counts.items()})
    assert len(many) < 3 * len(few)
    total = 1000 * sum(k * n for k, n in counts.items())
    assert max(b + (n - 1) // p for _, _, n, p, b, _ in many) + 1 <= 1.02 * total / 2048


def test_ids_are_the_tokenizers(spark):
    texts = ["Don't \"stop\" it's I'M  ok...", "ΣΑΣ Σ x\x1cy", "İstanbul Ünïcödé ﬁ—, é́x é, a…,b 12,34. ²x", "", None, "中文,abc ١٢٣. ß.", "naïve line ñ ̃x <|endoftext|>", "a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|>.", "Ça, été; ÷, ×! Ÿ. ſ? naïveté… façade--x don's, won't'", "a\x85b c\u2003d,\u3000e. \u00a0", "word, " * 1500, "The the THE the, (the) 'the's"]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(1, texts[1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = packing.pack(docs).collect()
    encoder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = []
    for i, t, _ in rows:
        ids = encoder.encode(t or "", add_special_tokens=False).ids + [0]
        expected += [(i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(expected)
    used = {}
    for r in got:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_letters_before_marks_are_the_tokenizers(spark):
    """Every letter behind which punctuation is tokenized apart, with every mark of ASCII."""
    texts = [" ".join(f"{a}{chr(c)}{m} {chr(c)}{m}{m}" for m in string.punctuation for a in ("", "Ab")) for c in (*range(0x21, 0x250), *range(0x370, 0x400), 0x1E9E, 0x212A, 0x2126)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in packing.token_pieces(docs, capacity=10**6, with_ids=True).collect()}
    encoder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert [i for i, t in enumerate(texts) if list(got[i]) != encoder.encode(t, add_special_tokens=False).ids + [0]] == []


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_without_an_id(spark):
    docs = spark.createDataFrame([(None, "one two"), (None, "one two"), (5, None)], "doc_id long, text string")
    got = packing.pack(docs).collect()
    assert sorted((r.doc_id is None, r.length) for r in got) == [(False, 1), (True, 3), (True, 3)]
