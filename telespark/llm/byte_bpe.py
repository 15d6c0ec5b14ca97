"""Byte-level BPE of a ``tokenizers`` file, with encodings kept by word.

A text is cut before single spaces that stand between two other characters: the pattern of the
byte-level splitter always ends a piece there, so the parts encode independently, and most of them
have been seen before. A word that is new goes to the library's model, or as a whole to the library
where its characters are not plain Latin or a special token may be inside.
"""

from __future__ import annotations

import json
import re
from array import array
from string import punctuation as PUNCTUATION

import regex
from tokenizers import Tokenizer

from telespark.llm import shared

#: The splitter of byte-level BPE (fixed value).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACES = frozenset("\t\v\f\r\x1c\x1d\x1e\x1f")
MOST = 600_000          # words kept in one Python worker



def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where it is visible Latin-1, else the next free one from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, free = {b: chr(b) for b in visible}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(free)
            free += 1
    return [letters[b] for b in range(256)]


class ByteEncoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = f.read()
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.special = [t["content"] for t in json.loads(spec)["added_tokens"]]
        self.pieces = regex.compile(PIECES).findall
        self.cut = re.compile(r"(?<=\S) (?=\S)").split
        self.after = re.compile(r" \s").search
        self.before = re.compile(r"[^\S ] ").search
        self.letters = byte_letters()
        self.kind = "H" if self.width == 2 else "I"
        self.tails: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}       # by word: the encoding of a space and the word

    @classmethod
    def of(cls, path: str) -> ByteEncoder:
        """One for each file and Python worker."""
        return shared.kept((cls.__name__, path), lambda: cls(path))

    @classmethod
    def shape(cls, path: str, end_id: int) -> tuple[int, int]:
        """Number of ids, and bytes of one."""
        encoder = cls.of(path)
        return max(encoder.tokenizer.get_vocab_size(), end_id + 1), encoder.width

    def _word(self, word: str) -> bytes:
        """A blank and a word, mostly letters and a run of punctuation: two pieces."""
        body = word.rstrip(PUNCTUATION)
        if not body.isalpha() or not body.isascii() and max(body) >= "ɐ":
            return self._part(" " + word)
        ids = self.known.get(body) if len(body) < len(word) else None
        if ids is None:
            letters = body if body.isascii() else "".join([self.letters[b] for b in body.encode()])
            ids = array(self.kind, [t.id for t in self.model.tokenize(self.letters[32] + letters)]).tobytes()
        if len(body) == len(word):
            return ids
        tail = word[len(body):]
        after = self.tails.get(tail)
        if after is None:
            after = self._piece(tail)
            if len(self.tails) < MOST:
                self.tails[tail] = after
        return ids + after

    def _part(self, part: str) -> bytes:
        if max(part, default="") < "ɐ" and not any(s in part for s in self.special):
            return b"".join(map(self._piece, self.pieces(part)))
        return array(self.kind, self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            piece = piece.replace(" ", self.letters[32])
        else:
            piece = "".join([self.letters[b] for b in piece.encode()])
        return array(self.kind, [t.id for t in self.model.tokenize(piece)]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian bytes."""
        known, out = self.known, []
        for text in texts:
            if text.isascii() and not SPACES.intersection(text):
                odd = "\n " in text or self.after(text)
            else:
                odd = self.before(text) or self.after(text)
            words = self.cut(text) if odd else text.split(" ")
            ids = list(map(known.get, words))
            ids[0] = self._part(words[0])
            if None in ids:
                for i, x in enumerate(ids):
                    if x is None:
                        ids[i] = x = self._word(words[i])
                        if len(known) < MOST:
                            known[words[i]] = x
            out.append(b"".join(ids))
        return out
