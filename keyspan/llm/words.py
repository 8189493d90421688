"""Words of a text as 64-bit values, by array operations on its bytes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_MULTIPLIER = 0xD1342543DE82EF95
_INVERSE = pow(_MULTIPLIER, -1, 2**64)
_SLICE = 1 << 20
_SPACE = np.array([i == 32 or 9 <= i <= 13 for i in range(256)])
_VALUES = np.random.default_rng(20240229).integers(1, 2**64, 256, np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = _LOWER[97:123]
_VALUES[65:91] = _VALUES[97:123]  # A-Z as a-z


@lru_cache(8)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0], done, step = 1, 1, base
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(step)
        done, step = done + more, step * step % 2**64
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over all others; one to one."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def _slice_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of the words of raw."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~_SPACE[raw]
    turn = np.diff(inside)
    start, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    if not len(start):
        return np.zeros(0, np.uint64), start, end
    n = 1 << max(12, len(raw).bit_length())
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUES[raw] * _powers(n, _MULTIPLIER)[: len(raw)], out=sums[1:])
    h = (sums[end] - sums[start]) * _powers(n, _INVERSE)[start]
    return mix64(h + (end - start).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)), start, end


def words_and_ends(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ in order, with A-Z as a-z, and the last two bytes of each as one number."""
    raw = np.frombuffer(text.encode(), np.uint8)
    found, ends, at = [], [], 0
    with np.errstate(over="ignore"):
        while at < len(raw):
            end = at + _SLICE
            if end < len(raw):
                gap = np.flatnonzero(_SPACE[raw[end : end + _SLICE]])
                while not len(gap) and end < len(raw):  # a word longer than a slice
                    end += _SLICE
                    gap = np.flatnonzero(_SPACE[raw[end : end + _SLICE]])
                end += int(gap[0]) if len(gap) else 0
            part = raw[at:end]
            h, first, last = _slice_words(part)
            low = _LOWER[part]
            found.append(h)
            ends.append(low[last - 1].astype(np.int64) | np.where(last - first > 1, low[last - 2], 0).astype(np.int64) << 8 if len(h) else np.zeros(0, np.int64))
            at = end
    return (np.concatenate(found), np.concatenate(ends)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words in order."""
    return words_and_ends(text)[0]


def words_of_all(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """words_and_ends of texts one after the other, and each text's number of words; short texts go through together."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at = 0
    while at < len(texts):
        first, size = at, 0
        while at < len(texts) and (at == first or size + 4 * len(texts[at]) < _SLICE):
            size += 4 * len(texts[at])
            at += 1
        if at - first == 1:
            h, ends = words_and_ends(texts[first])
            found.append((h, ends, np.array([len(h)])))
            continue
        raws = [t.encode() for t in texts[first:at]]
        raw = np.frombuffer(b"\n".join(raws), np.uint8)
        begins = np.cumsum([0, *[len(r) + 1 for r in raws]])
        with np.errstate(over="ignore"):
            h, start, last = _slice_words(raw)
        counts = np.diff(np.searchsorted(start, begins))
        low = _LOWER[raw]
        ends = low[last - 1].astype(np.int64) | np.where(last - start > 1, low[last - 2], 0).astype(np.int64) << 8 if len(h) else np.zeros(0, np.int64)
        found.append((h, ends, counts))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))
