"""Operator 2: BPE encoding by one walk over a trie of distinct words, and decoding.

For a prefix of a word let its *last token* be the last token of the prefix's encoding. An encoding
is the only sequence in which every two neighbours are compatible (encoding their joined strings
gives just the two), so the last token of a prefix is the one suffix token that is compatible with
the last token of what stands before it. Distinct words go into a trie, a depth-first walk hands the
last tokens down, and a prefix shared by many words is worked out once; the encoding of a word is
read off backwards from its leaf.

Defined cases: a null or empty text has no ids and decodes to the empty text; rows are independent,
so repeated rows and ids are encoded alike; an empty table gives an empty table; columns other than
``doc_id`` and ``text`` are not read by ``encode_documents``.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterable, Iterator
from string import punctuation as PUNCTUATION

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from telespark.llm import shared
from telespark.llm.byte_bpe import byte_letters

#: The splitter of the word-end tokenizer (fixed value).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
MOST = 150_000          # chunks, and words, kept in one Python worker



class Merges:
    """Merge table of a BPE model: which tokens may stand next to each other in an encoding."""

    def __init__(self, vocab: dict[str, int], merges: list, end: str):
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        self.rank_of = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(pairs)}
        self.parts = {vocab[a + b]: (vocab[a], vocab[b], r) for r, (a, b) in enumerate(pairs)}
        if len(self.parts) != len(pairs):
            raise ValueError("two merges make the same token: last tokens would not be unique")
        self.known: dict[tuple[int, int], bool] = {}
        sound: set[int] = set()                 # tokens whose own string encodes to themselves
        for token in vocab.values():
            if token not in self.parts:
                sound.add(token)
        for token, (a, b, rank) in self.parts.items():      # parts come before what is made of them
            if a in sound and b in sound and self._meet(a, b, rank):
                sound.add(token)
        self.inner = {s: i for s, i in vocab.items() if i in sound and not s.endswith(end)}
        self.final = {s[: -len(end)]: i for s, i in vocab.items() if i in sound and s.endswith(end) and s != end}
        self.longest = max(map(len, [*self.inner, *self.final]), default=1)

    def _meet(self, a: int, b: int, before: float) -> bool:
        """No merge of a rank under ``before`` would join across the border of ``a`` and ``b``.

        Takes the later of the two tokens apart, again and again: a pair that touched at the border
        while both existed must not have had its turn before one of them was merged into more.
        """
        ranks, parts = self.rank_of, self.parts
        while True:
            if ranks.get((a, b), before) < before:
                return False
            x, y = parts.get(a), parts.get(b)
            if x is None and y is None:
                return True
            if y is None or x is not None and x[2] > y[2]:
                a, before = x[1], x[2]
            else:
                b, before = y[0], y[2] + 1      # equal ranks merge from left to right

    def compatible(self, a: int, b: int) -> bool:
        ok = self.known.get((a, b))
        if ok is None:
            ok = self._meet(a, b, float("inf"))
            if len(self.known) < 4_000_000:
                self.known[a, b] = ok
        return ok


def trie_of(words: Iterable[str]) -> dict:
    """Nested dicts by letter; the key ``""`` marks the end of a word."""
    root: dict = {}
    for word in words:
        node = root
        for letter in word[:-1]:
            node = node.setdefault(letter, {})
        node.setdefault("", set()).add(word[-1])
    return root


def walk(root: dict, merges: Merges) -> Iterator[tuple[str, list[int]]]:
    """Every word of the trie with its encoding, depth first."""
    inner, final, longest, compatible = merges.inner, merges.final, merges.longest, merges.compatible
    lasts = [(-1, 0)]                           # by depth: last token, and the depth at which it starts

    def last_of(prefix: str, tokens: dict[str, int]) -> tuple[int, int]:
        depth = len(prefix)
        for start in range(max(0, depth - longest), depth):
            token = tokens.get(prefix[start:])
            if token is not None and (start == 0 or compatible(lasts[start][0], token)):
                return token, start
        raise ValueError(f"no encoding of {prefix!r}")

    waiting = [("", root)]
    while waiting:
        prefix, node = waiting.pop()
        depth = len(prefix)
        if depth:
            del lasts[depth:]
            lasts.append(last_of(prefix, inner))
        for letter in node.get("", ()):
            word = prefix + letter
            token, start = last_of(word, final)
            ids = [token]
            while start:
                token, start = lasts[start]
                ids.append(token)
            yield word, ids[::-1]
        waiting.extend((prefix + letter, child) for letter, child in node.items() if letter)


class TrieEncoder:
    """Encodes as the ``tokenizers`` library does with the same file (no special tokens added)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            text = f.read()
        spec = json.loads(text)
        model = spec["model"]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("a BPE file with word ends is needed")
        self.tokenizer = Tokenizer.from_str(text)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.merges = Merges(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.pieces = regex.compile(PIECES).findall
        self.letters = byte_letters()
        self.known: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {"": b""}
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.names = [""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.names[i] = name

    @classmethod
    def of(cls, path: str) -> TrieEncoder:
        """One for each file and Python worker."""
        return shared.kept((cls.__name__, path), lambda: cls(path))

    def words(self, chunk: str) -> list[str]:
        """The words of a chunk, in the letters that stand for bytes. Plain Latin is split here, the rest by the library's own steps."""
        if not (chunk.isascii() or max(chunk) < "ɐ" and "İ" not in chunk):
            return [x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(chunk))]
        chunk = chunk.lower()
        body = chunk.rstrip(PUNCTUATION)
        if body.isalpha():                      # letters and a run of punctuation
            found = [body, chunk[len(body):]] if len(body) < len(chunk) else [body]
        else:
            found = self.pieces(chunk)
        return found if chunk.isascii() and chunk.isprintable() else ["".join([self.letters[b] for b in x.encode()]) for x in found]

    def _learn(self, chunks: Iterable[str]) -> dict[str, bytes]:
        """Encodings of chunks: their distinct new words go through one trie."""
        split, out = {}, {}
        for chunk in chunks:
            if any(s in chunk for s in self.special):
                out[chunk] = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, dtype="<u4").tobytes()
            else:
                split[chunk] = self.words(chunk)
        known = self.known
        fresh = {w: array("I", ids).tobytes() for w, ids in walk(trie_of({w for x in split.values() for w in x} - known.keys()), self.merges)}
        for chunk, words in split.items():
            out[chunk] = b"".join([known[w] if w in known else fresh[w] for w in words])
        if len(known) < MOST:
            known.update(fresh)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, unsigned 32-bit little-endian. White space bounds words, so chunks between blanks encode alone."""
        parts = [text.split(" ") for text in texts]
        chunks = {c for x in parts for c in x}
        here = {c: self.chunks[c] for c in chunks & self.chunks.keys()}
        fresh = self._learn(chunks - here.keys())
        if len(self.chunks) < MOST:
            self.chunks.update(fresh)
        here |= fresh
        return [b"".join([here[c] for c in x]) for x in parts]

    def decode(self, ids: np.ndarray) -> str:
        """As the library's ``decode(ids, skip_special_tokens=False)`` without a decoder: token texts joined by a blank."""
        names = self.names
        return " ".join([names[i] for i in ids.tolist()])


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids): ids of every whole text, unsigned 32-bit little-endian."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TrieEncoder.of(tokenizer)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for low, high in shared.slices(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], pa.array(encoder.encode(texts[low:high]), pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode_documents(ids: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, text): the decoded texts of (doc_id, ids)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TrieEncoder.of(tokenizer)
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                texts = [encoder.decode(np.frombuffer(x or b"", dtype="<u4")) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.large_string()).cast(pa.string())], names=["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document: encoded, then decoded from the ids, in one pass by one worker."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TrieEncoder.of(tokenizer)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for low, high in shared.slices(texts):
                ids = encoder.encode(texts[low:high])
                decoded = [hashlib.sha256(encoder.decode(np.frombuffer(x, dtype="<u4")).encode()).hexdigest() for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[low:high], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array(decoded)],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
