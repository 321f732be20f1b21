"""Character n-grams of many texts at once, in numpy: letters lower-cased, everything else one space."""

from __future__ import annotations

import numpy as np

_LETTER = np.array([chr(i).isalpha() for i in range(0x10000)])
_P = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xBF58476D1CE4E5B9)


def letters(codes: np.ndarray) -> np.ndarray:
    """True where a code point is a letter."""
    out = _LETTER[np.minimum(codes, 0xFFFF)]
    high = codes > 0xFFFF
    if high.any():
        out[high] = [chr(c).isalpha() for c in codes[high]]
    return out


def chunks(texts, size: int = 1 << 19):
    """Groups of texts of about ``size`` characters, as (start, end); a longer text stands alone."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > size:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def squeezed(texts):
    """Texts -> code points with every run of non-letters as one space, and the text each of them belongs to. Every text
    starts and ends with a space."""
    low = [" " + t.lower() + " " for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    owner = np.repeat(np.arange(len(low), dtype=np.int32), [len(t) for t in low])
    is_letter = letters(codes)
    codes = np.where(is_letter, codes, np.uint32(32))
    keep = is_letter.copy()
    keep[0] = True
    keep[1:] |= is_letter[:-1]
    keep[1:] |= owner[1:] != owner[:-1]
    return codes[keep], owner[keep]


def hashed(codes: np.ndarray, owner: np.ndarray, n: int):
    """64-bit hashes of all n-grams inside one word, its two bounding spaces included, and their texts."""
    m = len(codes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    space = codes == 32
    ok = np.ones(m, bool)
    for k in range(1, n - 1):
        ok &= ~space[k:k + m]
    ok &= ~(space[:m] & space[n - 1:n - 1 + m]) if n == 2 else True
    ok &= owner[:m] == owner[n - 1:]
    at = np.flatnonzero(ok)
    h = np.full(len(at), np.uint64(n), np.uint64)
    for k in range(n):
        h = (h ^ codes[at + k].astype(np.uint64)) * _P
        h ^= h >> np.uint64(29)
    h *= _M
    h ^= h >> np.uint64(32)
    return h, owner[at]
