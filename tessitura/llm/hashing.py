"""Word hashes of many texts at once: one running sum over bytes gives every word and prefix its hash."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_SPACE = np.array([c == 0x20 or 9 <= c <= 13 for c in range(256)])
#: Bytes of a word when words end at ASCII white space.
NOT_SPACE = ~_SPACE
#: Bytes of a word made of ASCII letters, ASCII digits and everything beyond ASCII.
WORDLIKE = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)])
_CODES = np.random.default_rng(20241).integers(1, 1 << 63, 256, dtype=np.uint64)[_FOLD] * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps)
        if len(have) <= 1 << 23:
            _powers[base] = have
    return have[:n]


class Words(NamedTuple):
    """Words of several texts in order; ``text`` numbers the text of each word."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    sums: np.ndarray

    def prefix_hash(self, length: int | None = None) -> np.ndarray:
        """64-bit hash of each word with A-Z lowered, or of its first ``length`` bytes."""
        end = self.end if length is None else np.minimum(self.end, self.start + length)
        raw = (self.sums[end] - self.sums[self.start]) * _power(BASE_INVERSE, len(self.sums))[self.start]
        return mix(raw + (end - self.start).astype(np.uint64))

    def longer(self, length: int) -> Words:
        """Only the words of more than ``length`` bytes."""
        some = self.end - self.start > length
        return Words(self.text[some], self.start[some], self.end[some], self.sums)


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = NOT_SPACE) -> Words:
    """Maximal runs of bytes for which ``inside`` holds, never across two texts."""
    flags = np.zeros(len(data) + 2, bool)
    flags[1:-1] = inside[data]
    is_first = np.zeros(len(data) + 1, bool)
    is_first[offsets] = True
    starts = np.flatnonzero(flags[1:-1] & (~flags[:-2] | is_first[:-1]))
    ends = np.flatnonzero(flags[1:-1] & (~flags[2:] | is_first[1:])) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODES[data] * _power(BASE, len(data)), out=sums[1:])
    before = np.searchsorted(starts, offsets)
    return Words(np.repeat(np.arange(len(offsets) - 1), np.diff(before)), starts, ends, sums)


def shingles(found: Words, texts: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every run of ``width`` words; a text of fewer words, but not none, gives its whole sequence once."""
    own = found.prefix_hash()
    count = np.bincount(found.text, minlength=texts)
    first = np.cumsum(count) - count
    salt = [np.uint64((0xD6E8FEB86659FD93 * (2 * k + 1)) % (1 << 64)) for k in range(width)]
    n = max(0, len(own) - width + 1)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += mix(own[k : k + n] ^ salt[k])
    whole = found.text[:n] == found.text[width - 1 :] if n else np.zeros(0, bool)
    short = np.flatnonzero((count > 0) & (count < width))
    extra = np.zeros(len(short), np.uint64)
    for i, t in enumerate(short.tolist()):
        for k in range(count[t]):
            extra[i : i + 1] += mix(own[first[t] + k : first[t] + k + 1] ^ salt[k])
    text = np.concatenate([found.text[:n][whole], short])
    value = np.concatenate([total[whole], mix(extra + count[short].astype(np.uint64))])
    if len(short):
        order = np.argsort(text, kind="stable")
        text, value = text[order], value[order]
    return text, value
