"""Vectorised hashes of the substrings of a buffer, and of word windows."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)       # odd, so powers can be undone modulo 2**64
_UNDO = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(21, int(n - 1).bit_length())        # one size unless a buffer is very long
    if size not in _POWERS:
        _POWERS.clear()
        _POWERS[size] = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, _UNDO))
    return _POWERS[size]


class Words:
    """Words of a buffer, parted by single blanks or line ends, and hashes of any stretch of them.

    Hashes come from sums over prefixes, of a word's bytes and of a stretch's words: equal ones are
    equal wherever they stand. Bytes are gone through a piece at a time, so memory follows the words.
    """

    PIECE = 1 << 20

    def __init__(self, data: bytes):
        self.data = data
        self.letters = np.frombuffer(data, dtype=np.uint8)
        gaps = np.flatnonzero((self.letters == 32) | (self.letters == 10)) if data else np.empty(0, np.int64)
        self.starts = np.concatenate([[0], gaps + 1]) if data else gaps
        self.ends = np.concatenate([gaps, [len(data)]]) if data else gaps
        n = len(self.starts)
        self.word = np.empty(n, dtype=np.uint64)
        cuts = np.unique(np.append(np.searchsorted(self.starts, np.arange(0, len(data), self.PIECE)), n))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            low, high = int(self.starts[a]), int(self.ends[b - 1])
            self.word[a:b] = _stretches(self.letters[low:high].astype(np.uint64) + np.uint64(1), self.starts[a:b] - low, self.ends[a:b] - low)
        self._up, self._down = _powers(n + 1)
        self._up, self._down = self._up[:n + 1], self._down[:n + 1]
        self._sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.word * self._up[:n], out=self._sums[1:])

    def hashes(self, first: np.ndarray, until: np.ndarray) -> np.ndarray:
        """Of the words ``first`` to before ``until``."""
        return mixed((self._sums[until] - self._sums[first]) * self._down[first])


def _stretches(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def joined_words(texts: list[str]) -> tuple[Words, np.ndarray]:
    """The words of all texts (bytes between ASCII white space) parted by single blanks, and their number in each text."""
    counts, lines = np.zeros(len(texts), dtype=np.int64), []
    for i, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").split()
        counts[i] = len(words)
        if words:
            lines.append(b" ".join(words))
    return Words(b" ".join(lines)), counts
