"""Operators 1 and 2 against the tokenizers library, and their formats."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from telespark.llm import shared, token_files, word_bpe
from telespark.llm.byte_bpe import ByteEncoder

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "  two  blanks ", "a\n b\t c \n", "x<|endoftext|>y <|startoftext|> z", "don't WE'LL", "é́ ΑΣ ΟΔΟΣ. İı", "漢字🙂 x y z",
       "aaaaaaaaaaaaaaaa abababab " * 3, "end.*** reed%%%", "1234 ½ Ⅷ", "\x1c\x1dz a\x85b", "word " * 20000]


@pytest.fixture(scope="module")
def libraries():
    return Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, bucket int")


def test_token_files(spark, libraries):
    rows = [(i, t, "clash", 7) for i, t in enumerate(ODD)] + [(5, ODD[5], "clash", 7), (None, "no id", None, None)]
    path = shared.fresh_path(spark, "files")
    token_files.write_files(docs(spark, rows), path, BYTES, end_id=0)
    got = sorted(map(tuple, token_files.digests(spark, path).collect()), key=lambda r: r[1])
    at, want = 0, []
    for doc_id, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*libraries[0].encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    full = {(r.start, r.doc_id): r.ids for r in token_files.read_files(spark, path).collect()}
    assert {k: (len(v) // 4, zlib.crc32(v)) for k, v in full.items()} == {(r[1], r[0]): r[2:] for r in want}


def test_token_files_of_nothing(spark):
    path = shared.fresh_path(spark, "files")
    token_files.write_files(docs(spark, []), path, BYTES)
    assert token_files.read_files(spark, path).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 10 ** 6), min_size=0, max_size=300), st.integers(9, 18))
def test_code_is_optimal_and_limited(counts, limit):
    lengths = token_files.code_lengths(np.array(counts, dtype=np.int64), limit)
    used = lengths[lengths > 0].astype(int)
    assert (lengths > 0).tolist() == [c > 0 for c in counts]
    if len(used) > 1:
        assert used.max() <= limit and sum(2.0 ** -x for x in used) == 1.0


def test_code_is_as_short_as_huffman():
    import heapq
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 0, 7])
    heap = [c for c in counts.tolist() if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        joined = heapq.heappop(heap) + heapq.heappop(heap)
        cost += joined
        heapq.heappush(heap, joined)
    assert (token_files.code_lengths(counts, 18) * counts).sum() == cost
    assert token_files.code_lengths(counts, 4).max() == 4


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
def test_blocks_decode(n):
    ids = np.random.default_rng(n).zipf(1.5, n) % 1000
    code = token_files.Code(token_files.code_lengths(np.bincount(np.append(ids, 3), minlength=1000)))
    bits, offsets = code.encode(ids)
    assert code.decode(bits, offsets, n).tolist() == ids.tolist()


def test_byte_encoder_is_the_library(libraries):
    encoder = ByteEncoder(BYTES)
    for text in ODD:
        assert np.frombuffer(encoder.encode([text or ""])[0], "<u2").tolist() == libraries[0].encode(text or "", add_special_tokens=False).ids


def test_round_trip(spark, libraries):
    rows = [(i, t, "clash", 7) for i, t in enumerate(ODD)] + [(1, ODD[5], None, None)]
    got = sorted(map(tuple, word_bpe.round_trip(docs(spark, rows), WORDS).collect()))
    want = []
    for doc_id, text, *_ in rows:
        ids = libraries[1].encode(text or "", add_special_tokens=False).ids
        decoded = libraries[1].decode(ids, skip_special_tokens=False)
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert got == sorted(want)
    assert word_bpe.round_trip(docs(spark, []), WORDS).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="etahonirsd'.,*é ABß1\n", max_size=40), max_size=5))
def test_trie_is_the_library(texts):
    encoder, library = word_bpe.TrieEncoder.of(WORDS), Tokenizer.from_file(WORDS)
    for text, ids in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_trie_shares_prefixes():
    encoder = word_bpe.TrieEncoder.of(WORDS)
    words = ["there", "therefore", "then", "the"]
    assert {w: [encoder.names[i] for i in ids] for w, ids in word_bpe.walk(word_bpe.trie_of(words), encoder.merges)}["the"] == ["the</w>"]
