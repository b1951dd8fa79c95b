"""Word shingles of whole texts as sorted 64-bit hashes, many texts at a time."""

from __future__ import annotations

import numpy as np

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 64, 2 * len(_powers))
        _powers = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _MULTIPLIER, np.uint64)], dtype=np.uint64)
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread each 64-bit number over all its bits (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: list[str | None], size: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its ``size``-word shingles.

    A-Z are lower-cased, words are runs of anything but blanks and control characters 9 to 13. A
    text with fewer words has its whole sequence as one shingle; null or wordless texts none.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw])
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    begins = np.flatnonzero(~gap & np.r_[True, gap[:-1]])
    if not len(begins):
        return [np.zeros(0, np.uint64) for _ in texts]
    letters = data + ((data >= 65) & (data <= 90)) * np.uint8(32)
    at = np.arange(len(data))
    first = np.zeros(len(data), np.int64)
    first[begins] = begins
    place = at - np.maximum.accumulate(first)
    place[gap] = 0
    power = _power_table(int(place.max()) + 1)
    value = np.where(gap, np.uint64(0), (letters.astype(np.uint64) + np.uint64(1)) * power[place])
    word = mixed(np.add.reduceat(value, begins))
    power = _power_table(size + 1)
    shingle = np.zeros(max(len(word) - size + 1, 0), np.uint64)
    for k in range(size if len(shingle) else 0):
        shingle += word[k:k + len(shingle)] * power[k + 1]
    shingle = mixed(shingle)
    low = np.searchsorted(begins, ends - [len(r) + 1 for r in raw])
    high = np.searchsorted(begins, ends)
    out = []
    for a, b in zip(low.tolist(), high.tolist()):
        if b - a >= size:
            out.append(np.unique(shingle[a:b - size + 1]))
        elif b > a:
            part = (word[a:b] * power[1:b - a + 1]).sum(dtype=np.uint64)
            out.append(mixed(np.array([part + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
