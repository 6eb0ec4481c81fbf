"""Vectorised word and shingle hashing over batches of texts (runs inside Arrow tasks)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_U = np.uint64
#: Bytes of text hashed at once: bounds the temporary arrays (about 40 bytes for each).
SLICE_BYTES = 1 << 20

_TABLE = np.random.default_rng(20240917).integers(0, 2**64, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: White space of the words `[^\x20\x09-\x0D]+`.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Anything but ASCII letters and bytes of non-ASCII characters.
_NON_LETTER = np.ones(256, bool)
_NON_LETTER[65:91] = _NON_LETTER[97:123] = _NON_LETTER[128:] = False

_P = 0x9E3779B97F4A7C1B  # 3 modulo 8, so that powers lose few low bits
_P_INV = pow(_P, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES + 1024), base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 4 * SLICE_BYTES:
            _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole word."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def slices(texts: Iterable[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about SLICE_BYTES each; every text is whole in one range."""
    start = size = at = 0
    for at, t in enumerate(texts):
        if size and size + len(t) > SLICE_BYTES:
            yield start, at
            start, size = at, 0
        size += len(t)
    if size or start <= at:
        yield start, at + 1


def gaps(letters_only: bool) -> np.ndarray:
    """Which byte values separate words."""
    return _NON_LETTER if letters_only else _SPACE


def pieces(text: bytes, gap: np.ndarray, overlap: int = 0, most: int | None = None) -> list[bytes]:
    """The text in parts of about `most` bytes, cut between words; each part begins with the last `overlap` words of the one before.

    So a very long text never needs temporary arrays of its own size. A word longer than `most` stays whole.
    """
    most = most or SLICE_BYTES
    if len(text) <= most:
        return [text]
    data, out, at = np.frombuffer(text, np.uint8), [], 0
    while len(text) - at > most:
        free = np.flatnonzero(gap[data[at : at + most]])
        end = at + int(free[-1]) + 1 if len(free) else at + most
        while not len(free) and end < len(text):  # one word fills the part
            more = np.flatnonzero(gap[data[end : end + most]])
            end = end + int(more[0]) + 1 if len(more) else min(len(text), end + most)
            if len(more):
                break
        out.append(text[at:end])
        edges = np.flatnonzero(np.diff(gap[data[at:end]], prepend=True))[0::2] if overlap else ()
        at = at + int(edges[-overlap]) if overlap and len(edges) > overlap else end
    return [*out, text[at:]] if at < len(text) else out


def in_pieces(texts: list[bytes], letters_only: bool, overlap: int = 0) -> tuple[list[bytes], np.ndarray]:
    """All texts' pieces in order, and the place of each text's first one."""
    gap = gaps(letters_only)
    parts = [pieces(t, gap, overlap) for t in texts]
    return [p for ps in parts for p in ps], np.cumsum([0] + [len(ps) for ps in parts])[:-1]


class Words:
    """The words of some texts: byte range, hash and count for each text."""

    def __init__(self, texts: list[bytes], letters_only: bool = False):
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        gap = gaps(letters_only)[data]
        self.lower = _LOWER[data]
        edge = np.flatnonzero(np.diff(gap, prepend=True))
        self.start, self.end = edge[0::2], edge[1::2]
        n = len(data)
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_TABLE[self.lower] * _powers(_P, n), out=sums[1:])
        self.sums = sums
        self.hash = mix((sums[self.end] - sums[self.start]) * _powers(_P_INV, n + 1)[self.start])
        limits = np.cumsum([0] + [len(t) + 1 for t in texts])
        #: first word of each text, and one past the last
        self.first = np.searchsorted(self.start, limits)

    def prefix_hash(self, length: int) -> np.ndarray:
        """Hash of the first `length` bytes of each word; 0 for shorter words."""
        n = len(self.lower)
        end = np.minimum(self.start + length, n)
        h = mix((self.sums[end] - self.sums[self.start]) * _powers(_P_INV, n + 1)[self.start] + _U(length))
        return np.where(self.end - self.start >= length, h, _U(0))


#: Odd multipliers, one for each place in a shingle.
_PLACES = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]


def shingle_sets(texts: list[bytes], width: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles.

    Words are runs of non-white-space, A-Z lower-cased. A text of fewer words than `width` has its
    whole sequence as its one shingle; a text without words has none. Of a very long text only word and
    shingle hashes are held at once (about 8 bytes a word each, and as much to sort them).
    """
    places = [_U((_PLACES[i % 5] + 2 * (i // 5)) % 2**64) for i in range(width)]
    for lo, hi in slices(texts):
        if hi - lo == 1 and len(texts[lo]) > SLICE_BYTES:
            words = np.concatenate([Words([p]).hash for p in pieces(texts[lo], _SPACE)])
            first = np.array([0, len(words)])
        else:
            w = Words(texts[lo:hi])
            words, first = w.hash, w.first
        n = len(words)
        rolled = np.zeros(max(n - width + 1, 0), np.uint64)
        for i, p in enumerate(places):
            rolled += words[i : i + len(rolled)] * p
        rolled = mix(rolled)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= width:
                yield distinct(rolled[a : b - width + 1])
            elif b > a:
                short = np.array([b - a], np.uint64)
                for i in range(a, b):
                    short = (short ^ words[i]) * places[i - a]
                yield mix(short)
            else:
                yield np.empty(0, np.uint64)
