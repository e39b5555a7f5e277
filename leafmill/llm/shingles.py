"""Word shingles of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

#: Words of a shingle.
WORDS = 5
_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words whose outputs look random."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _inverse(odd: int) -> int:
    x = odd
    for _ in range(6):
        x = x * (2 - odd * x) % (1 << 64)
    return x


_BACK = np.uint64(_inverse(int(_ODD)))
#: Random 64-bit values of the bytes; 0 for those that separate words. A-Z count as a-z.
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[65:91] = True
_WORD[128:] = True
_BYTES[65:91] = _BYTES[97:123]


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def shingles(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, times it occurs) of all shingles of the lower-cased texts.

    A word is a run of ASCII letters and digits and of characters beyond ASCII. A text of fewer words than a
    shingle's is one shingle; a text without any has none. Sorted by text, then hash.
    """
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    inside = _WORD[data]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # a word's hash: its bytes' values times powers of an odd number, shifted back to power 0
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * _powers(_ODD, len(data)), dtype=np.uint64)])
    word = mix((prefix[last] - prefix[first]) * _powers(_BACK, len(data))[first] + (last - first).astype(np.uint64))
    owner = np.searchsorted(ends, first, side="right")
    counts = np.bincount(owner, minlength=len(texts))
    starts = np.cumsum(counts) - counts
    total = np.zeros(len(word), np.uint64)
    place = np.arange(len(word)) - starts[owner]
    left = counts[owner] - place  # words from here to the text's end
    for k in range(words):
        shifted = np.zeros(len(word), np.uint64)
        shifted[: max(0, len(word) - k)] = word[k:]
        total = np.where(left > k, total * _ODD + shifted, total)
    keep = (left >= words) | (place == 0)
    owner, value = owner[keep], mix(total[keep])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])])
    at = np.flatnonzero(new)
    return owner[at].astype(np.int64), value[at], np.diff(np.append(at, len(owner)))
