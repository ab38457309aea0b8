"""Vectorised text measures: words, lines and n-grams of a batch of texts as numpy arrays.

A batch of texts becomes one array of code points; prefix sums of a polynomial hash give the 64-bit hash of any
slice in constant time, so that words, lines, segments and shingles are hashed without a Python loop over them.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np

U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_TABLES: dict[int, np.ndarray] = {}


def _char_codes(family: int) -> np.ndarray:
    if family not in _TABLES:
        _TABLES[family] = mix(np.arange(1, 0x110001, dtype=U) * U(0xD6E8FEB86659FD93) + U(family * 0x9FB21C651E98DF25 & 0xFFFFFFFFFFFFFFFF))
    return _TABLES[family]


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        steps = np.full(size, base, dtype=U)
        steps[0] = 1
        _powers[base] = have = np.cumprod(steps, dtype=U)
    return have


def codepoints(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All code points in a row, and the offsets of the texts in them; null counts as empty."""
    parts = [t if isinstance(t, str) else "" for t in texts]
    offsets = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in parts], out=offsets[1:])
    return np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), offsets


def ascii_lower(points: np.ndarray) -> np.ndarray:
    return points + ((points >= 65) & (points <= 90)).astype(np.uint32) * np.uint32(32)


def is_blank(points: np.ndarray) -> np.ndarray:
    """White space as words are split by: U+0020 and U+0009 to U+000D."""
    return (points == 32) | ((points >= 9) & (points <= 13))


class Slices:
    """Hashes of slices [start, end) of a code point array; another family of hashes agrees by chance only."""

    def __init__(self, points: np.ndarray, family: int = 0):
        n = len(points)
        self.family = family
        self.prefix = np.zeros(n + 1, dtype=U)
        np.cumsum(_char_codes(family)[points] * _power(_P, n + 1)[:n], out=self.prefix[1:])
        self.back = _power(_P_INV, n + 1)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.back[start] + (end - start).astype(U) * U(0xA24BAED4963EE407))


def runs(flags: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that do not cross a text's border."""
    n = len(flags)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    border = np.zeros(n + 1, dtype=bool)
    border[offsets] = True
    before = np.concatenate(([False], flags[:-1]))
    after = np.concatenate((flags[1:], [False]))
    return np.flatnonzero(flags & (~before | border[:-1])), np.flatnonzero(flags & (~after | border[1:])) + 1


class Words:
    """The words of a batch: start, end, hash, and by text the range of its words (first, last + 1)."""

    def __init__(self, points: np.ndarray, offsets: np.ndarray):
        self.blank = is_blank(points)
        self.start, self.end = runs(~self.blank, offsets)
        self.slices = Slices(points)
        self.hash = self.slices.hash(self.start, self.end)
        self.range = np.searchsorted(self.start, offsets)


_LANES = mix(np.arange(101, 133, dtype=U)) | U(1)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n words in a row; entries that cross a text's border are the caller's to leave out."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=U)
    total = np.full(m, U(n * 0x9FB21C651E98DF25 & 0xFFFFFFFFFFFFFFFF), dtype=U)
    for k in range(n):
        total += words[k : k + m] * _LANES[k]
    return mix(total)


def batches_by_chars(texts: list, most: int) -> Iterator[slice]:
    """Slices of ``texts`` with about ``most`` characters each; a longer text is a slice of its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if isinstance(t, str) else 0
        if size and size + n > most:
            yield slice(start, i)
            start, size = i, 0
        size += n
    if start < len(texts):
        yield slice(start, len(texts))


#: Scripts that are written without spaces between words: every character of theirs is a word. First and last code points.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x3029), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x323AF))
_SMALL = 0x0E00
_letters: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _letter_table(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: its lower case, whether it is a letter, digit or mark, and whether it is a word by itself."""
    size = _SMALL if not len(points) or int(points.max()) < _SMALL else 0x110000
    if size not in _letters:
        fold = np.arange(size, dtype=np.uint32)
        word, alone = np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)
        for c in range(size):
            sign = chr(c)
            if unicodedata.category(sign)[0] in "LNM":
                word[c] = True
                low = sign.lower()
                if low != sign and len(low) == 1:
                    fold[c] = ord(low)
        for a, b in UNSPACED:
            alone[a : min(b + 1, size)] = word[a : min(b + 1, size)]
        _letters[size] = fold, word, alone
    return _letters[size]


def folded_words(texts: list[str | None]) -> Words:
    """Words for matching: runs of letters, digits and marks in lower case, whatever stands around them; single characters of UNSPACED scripts."""
    points, offsets = codepoints(texts)
    fold, word, alone = _letter_table(points)
    words = Words.__new__(Words)
    inside, single = word[points], alone[points]
    words.blank = ~inside
    if single.any():
        border = np.zeros(len(points) + 1, dtype=bool)
        border[offsets] = True
        border[:-1] |= single  # a single one begins a word, and so does what follows it
        border[1:] |= single
        before, after = np.concatenate(([False], inside[:-1])), np.concatenate((inside[1:], [False]))
        words.start = np.flatnonzero(inside & (~before | border[:-1]))
        words.end = np.flatnonzero(inside & (~after | border[1:])) + 1
    else:
        words.start, words.end = runs(inside, offsets)
    words.slices = Slices(fold[points])
    words.hash = words.slices.hash(words.start, words.end)
    words.range = np.searchsorted(words.start, offsets)
    return words
