"""Word shingles of whole texts as 64-bit hashes, a batch at a time in numpy."""

from __future__ import annotations

import numpy as np

from veinstone.llm.common import kept_in_tasks

SEGMENT = 1 << 21
_P = 0x9E3779B97F4A7C15 | 1
_INV = pow(_P, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
kept_in_tasks("powers", _powers.clear)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers; a longer table begins with a shorter one, so the longest is the only one."""
    size = max([1 << max(12, (n - 1).bit_length()), *_powers])
    if size not in _powers:
        _powers.clear()
        one = np.full(size, _P, np.uint64)
        inv = np.full(size, _INV, np.uint64)
        one[0] = inv[0] = 1
        _powers[size] = (np.multiply.accumulate(one), np.multiply.accumulate(inv))
    return _powers[size]


def _segment_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of one segment."""
    b = np.frombuffer(raw, np.uint8)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.zeros(0, np.uint64), start
    power, inverse = _power_table(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64)), start


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and byte offsets of the words [^\\x20\\x09-\\x0D]+ of raw, A-Z lower-cased."""
    raw = raw.lower()  # bytes.lower() changes A-Z only
    hashes, starts, at = [], [], 0
    while at < len(raw):
        stop = min(len(raw), at + SEGMENT)
        while stop < len(raw) and raw[stop] not in b" \t\n\x0b\x0c\r":
            stop += 1
        h, s = _segment_hashes(raw[at:stop])
        hashes.append(h)
        starts.append(s + at)
        at = stop
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def shingle_sets(texts: list[str], width: int = 5) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, ascending; fewer words than width make one shingle, none make none."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    h, start = word_hashes(b" ".join(raw))
    offsets = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])]) if raw else np.zeros(1, np.int64)
    cut = np.searchsorted(start, offsets)
    m = np.uint64(0xD6E8FEB86659FD93)
    if len(h) >= width:
        rolled = h[: len(h) - width + 1].copy()
        for k in range(1, width):
            rolled = rolled * m + h[k : len(h) - width + 1 + k]
        rolled = mix(rolled)
    out = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            x = h[a]
            with np.errstate(over="ignore"):
                for k in range(a + 1, b):
                    x = x * m + h[k]
                out.append(mix(np.array([x + np.uint64(b - a) * np.uint64(_P)])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
