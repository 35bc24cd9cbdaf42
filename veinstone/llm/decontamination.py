"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts and benchmark items are normalised (lower case; runs of anything but
letters and digits are one space).  An item is searched for as windows of
WINDOW characters, half overlapping (a shorter item is one window), and for
excerpts of SHORT characters at every STRIDE.  So a verbatim excerpt of
SHORT + STRIDE - 1 characters holds a whole window wherever it begins in its
item; shorter ones of a longer item may not.  A window of
w characters found with at most k = floor(RATE * w) edits shares at least
w - Q + 1 - k * Q of its q-grams with the text, within diagonals that differ by
k at most.  So shared q-grams are counted in overlapping diagonal bands, bands
that reach the bound are retained, and a banded alignment of the window with
the text decides, many bands at once.

Equal windows are one window with a list of items, and windows of several
items are decided first: where one is found, the windows of a single item of
its list that overlap it are not searched again.  So a common instruction at
the head of many items costs one search, not one for each.  Texts are searched
in slices, and a slice in ranges of windows where its shared q-grams are many,
so memory is bounded however repetitive text and items are.

The benchmark is a stated query set: it goes to the executors in blocks of at
most BLOCK_CHARS characters, all in one pass over the documents: where there
are several, a task gathers GATHER bytes of text, searches them in one block
after another and holds one block's index at a time.  Items of fewer than Q
normalised characters are found only as the whole of a text: within others
they are too short to tell.  Items without a letter or digit match nothing.

Null and empty texts hold nothing.  Every row is judged on its own and whole,
so repeated rows get equal results and hot keys need no shuffle.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.llm.common import kept_in_tasks, read_table, slices, tidied

Q = 10
WINDOW = 100
SHORT, STRIDE = 60, 10
RATE = 0.08
#: Each character is in about 2 + SHORT / STRIDE windows, so a block makes some seven times as many q-grams.
BLOCK_CHARS = 600_000
GATHER = 32 << 20
#: Positions of text counted at once, at most and at least, and the shared q-grams that may be in memory.
SLICE, LEAST_SLICE, MOST_HITS = 1 << 17, 1 << 10, 1 << 21
#: More than any window's edits, so that no alignment reaches from one text into the next.
GAP = 16
ALIGNED = 1 << 14
_P = 0x9E3779B97F4A7C15 | 1
_BITS = 20
OUT = "doc_id long, contaminated boolean, n_items long, item_ids string, spans string"
Found = tuple[set, list]
_folded: np.ndarray | None = None


def _fold_table() -> np.ndarray:
    """Code point to its lower case if it is a letter or digit, else to 32."""
    global _folded
    if _folded is None:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalnum():
                low = s.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _folded = table
    return _folded


def normalise(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Normalised code points and the place of each in text."""
    points = _fold_table()[np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")]
    space = points == 32
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    at = np.flatnonzero(keep)
    return points[at], at


def trimmed(points: np.ndarray) -> np.ndarray:
    """Without spaces at the ends."""
    used = np.flatnonzero(points != 32)
    return points[used[0] : used[-1] + 1] if len(used) else points[:0]


def qgrams(points: np.ndarray) -> np.ndarray:
    """Hashes of all q-grams."""
    n = len(points) - Q + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    p, h = np.uint64(_P), points[:n].astype(np.uint64)
    for k in range(1, Q):
        h *= p
        h += points[k : n + k]
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


class Index:
    """The distinct windows of one block of items and the places of their q-grams."""

    def __init__(self, items: list[tuple[int, str]]):
        owners: dict[bytes, set[int]] = {}
        self.whole: dict[bytes, set[int]] = {}
        for item, text in items:
            points = trimmed(normalise(text)[0])
            if not len(points):
                continue
            if len(points) < Q:
                self.whole.setdefault(points.tobytes(), set()).add(item)
                continue
            last = max(0, len(points) - WINDOW)
            ranges = {(a, min(len(points), a + WINDOW)) for a in (*range(0, last, WINDOW // 2), last)}
            tail = max(0, len(points) - SHORT)
            ranges |= {(a, min(len(points), a + SHORT)) for a in (*range(0, tail, STRIDE), tail)}
            for a, b in sorted(ranges):
                owners.setdefault(points[a:b].tobytes(), set()).add(item)
        self.windows = [np.frombuffer(w, np.uint32) for w in owners]
        self.size = np.array([len(w) for w in self.windows], np.int64)
        self.owner_from = np.concatenate([[0], np.cumsum([len(o) for o in owners.values()])]).astype(np.int64)
        self.owner = np.array([i for o in owners.values() for i in sorted(o)], np.int64)
        self.budget = (RATE * self.size).astype(np.int64)
        self.bound = np.maximum(1, self.size - Q + 1 - self.budget * Q)
        start = np.cumsum(self.size) - self.size
        h = qgrams(np.concatenate(self.windows)) if self.windows else np.zeros(0, np.uint64)
        window = np.repeat(np.arange(len(self.size)), self.size)[: len(h)]
        place = np.arange(len(h)) - start[window]
        inside = place + Q <= self.size[window]  # not across two windows
        h, window, place = h[inside], window[inside], place[inside]
        order = np.argsort(h, kind="stable")  # by hash, then window, then place
        self.hash, first, gram = np.unique(h[order], return_index=True, return_inverse=True)
        self.slot_from = np.append(first, len(h)).astype(np.int64)
        self.window, self.place = window[order], place[order]
        self.by_window = gram * max(1, len(self.windows)) + self.window  # ascending: finds a gram's slots in a range of windows
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[(h >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    # -- shared q-grams in diagonal bands --

    def bands(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, first diagonal) of the bands of twice budget + 1 diagonals that reach the window's bound."""
        h = qgrams(points)
        at = np.flatnonzero(self.bitmap[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        gram = np.minimum(np.searchsorted(self.hash, h[at]), max(0, len(self.hash) - 1))
        shared = self.hash[gram] == h[at] if len(self.hash) else np.zeros(len(at), bool)
        at, gram = at[shared], gram[shared]
        found = list(self._sliced(at, gram, 0, len(points), SLICE)) if len(at) else []
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([w for w, _ in found]), np.concatenate([d for _, d in found])

    def _sliced(self, at, gram, low: int, high: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for start in range(low, high, width):
            # Slices overlap by what a window's band can reach, so each occurrence lies whole in one.
            a, b = np.searchsorted(at, [start, min(start + width, high) + 2 * WINDOW])
            hits = int((self.slot_from[gram[a:b] + 1] - self.slot_from[gram[a:b]]).sum())
            if hits > MOST_HITS and width > LEAST_SLICE:
                yield from self._sliced(at, gram, start, min(start + width, high), width // 2)
            elif hits:
                yield from self._counted(at[a:b], gram[a:b], start, hits, 0, len(self.windows))

    def _counted(self, at, gram, start: int, hits: int, first: int, stop: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Bands of the windows from first to stop; the range is halved while it holds too many hits."""
        total = len(self.windows)
        low, high = (self.slot_from[gram], self.slot_from[gram + 1]) if stop - first == total else (np.searchsorted(self.by_window, gram * total + x) for x in (first, stop))
        times = high - low
        n = int(times.sum())
        if not n:
            return
        if n > MOST_HITS and stop - first > 1:
            middle = (first + stop) // 2
            yield from self._counted(at, gram, start, n, first, middle)
            yield from self._counted(at, gram, start, n, middle, stop)
            return
        slot = np.repeat(low - np.cumsum(times) + times, times) + np.arange(n)
        window = self.window[slot]
        band = (np.repeat(at - start, times) - self.place[slot] + WINDOW) // (self.budget[window] + 1)
        wide = int(band.max()) + 2
        present = np.zeros(stop - first, bool)
        present[window - first] = True
        used = np.flatnonzero(present) + first
        key = (np.cumsum(present) - 1)[window - first] * wide + band
        if len(used) * wide <= 8 * n:
            count = np.bincount(key, minlength=len(used) * wide + 1)
            both, key = count[:-1] + count[1:], np.flatnonzero(count[:-1])
            both = both[key]
        else:
            key, count = np.unique(key, return_counts=True)
            both = count.copy()
            both[:-1] += np.where(key[1:] == key[:-1] + 1, count[1:], 0)
        # A band and the next one: any budget + 1 neighbouring diagonals lie in such a pair that begins with a hit.
        window = used[key // wide]
        enough = both >= self.bound[window]
        window = window[enough]
        yield window, key[enough] % wide * (self.budget[window] + 1) - WINDOW + start

    # -- alignment --

    def aligned(self, points: np.ndarray, window: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, first, end) of the bands in which the window occurs within its budget."""
        out = [(np.zeros(0, np.int64),) * 3]
        for n in np.unique(self.size[window]).tolist():
            rows = np.flatnonzero(self.size[window] == n)
            for at in range(0, len(rows), ALIGNED):
                part = rows[at : at + ALIGNED]
                patterns = np.stack([self.windows[w] for w in window[part].tolist()])
                k = int(RATE * n)
                ok, first, end = align(patterns, points, low[part], 2 * k + 2, k)
                out.append((window[part][ok], first[ok], end[ok]))
        return tuple(np.concatenate(x) for x in zip(*out))

    def matches(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, first, end) of the windows that points hold within their budgets; shared windows first."""
        window, low = self.bands(points)
        if not len(window):
            return window, low, low
        shared = np.diff(self.owner_from)[window] > 1
        out = self.aligned(points, window[shared], low[shared])
        window, low = window[~shared], low[~shared]
        if len(out[0]) and len(window):
            # (item, place) of the shared windows found: a single window of that item near it is skipped.
            wide = len(points) + 4 * WINDOW
            rank = np.unique(self.owner)
            item, row = self.items(out[0])
            known = np.unique(np.searchsorted(rank, item) * wide + out[1][row])
            own = np.searchsorted(rank, self.owner[self.owner_from[window]]) * wide
            near = np.searchsorted(known, own + np.maximum(0, low - WINDOW)) < np.searchsorted(known, own + low + self.size[window], "right")
            window, low = window[~near], low[~near]
        single = self.aligned(points, window, low)
        return tuple(np.concatenate(x) for x in zip(out, single))

    def items(self, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The items of each window, and the row of window that each belongs to."""
        low, times = self.owner_from[window], self.owner_from[window + 1] - self.owner_from[window]
        row = np.repeat(np.arange(len(window)), times)
        return self.owner[np.repeat(low - np.cumsum(times) + times, times) + np.arange(len(row))], row

    def search(self, texts: list[str | None]) -> list[Found]:
        """Items found in each text, and the merged places, in its own code points."""
        parts, places, starts, size = [], [], [], 0
        gap = np.full(GAP, 0xFFFFFFFF, np.uint32)
        for t in texts:
            points, at = normalise(t) if isinstance(t, str) and t else (gap[:0], gap[:0])
            parts += [points, gap]
            places.append(at)
            starts.append(size)
            size += len(points) + GAP
        out: list[Found] = [(set(), []) for _ in texts]
        if not texts:
            return out
        window, first, end = self.matches(np.concatenate(parts))
        doc = np.searchsorted(starts, (first + end) // 2, "right") - 1  # edits may reach into a gap, middles don't
        item, row = self.items(window)
        kinds, rank = np.unique(item, return_inverse=True)
        for pair in np.unique(doc[row] * max(1, len(kinds)) + rank).tolist():
            out[pair // len(kinds)][0].add(int(kinds[pair % len(kinds)]))
        reach = 4 * WINDOW  # more than any occurrence is long
        for a, length in zip(*(x.tolist() for x in np.divmod(np.unique(first * reach + np.maximum(0, end - first)), reach))):
            if length:
                d = bisect.bisect_right(starts, a + length // 2) - 1
                at, b = places[d], a + length - starts[d]
                a, b = int(at[max(0, a - starts[d])]), int(at[min(b, len(at)) - 1]) + 1
                merged = out[d][1]
                if merged and a <= merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
                else:
                    merged.append((a, b))
        if self.whole:
            for d, points in enumerate(parts[::2]):
                if 0 < len(points) <= Q + 1 and (own := self.whole.get((t := trimmed(points)).tobytes())):
                    out[d][0].update(own)
                    a = int(places[d][np.flatnonzero(points != 32)[0]])
                    out[d][1].append((a, int(places[d][np.flatnonzero(points != 32)[-1]]) + 1))
        return out


def align(patterns: np.ndarray, text: np.ndarray, low: np.ndarray, diagonals: int, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(found, first, end): where each pattern occurs in text with at most budget edits.

    Row r's occurrence begins between low[r] - budget and low[r] + diagonals - 1 +
    budget.  Banded: cell (i, o) compares pattern[i] with text[low - budget + i + o].
    A cell holds its cost and, in its lower bits, how far before the last column
    its alignment began, so that one minimum decides both.
    """
    n, width = patterns.shape[1], diagonals + 2 * budget
    bits = int(width).bit_length()
    one, o = 1 << bits, np.arange(width, dtype=np.int32) << bits
    base = low - budget
    at = base[:, None] + np.arange(n + width)
    inside = (at >= 0) & (at < len(text))
    near = np.where(inside, text[np.clip(at, 0, max(0, len(text) - 1))], np.uint32(0xFFFFFFFE)) if len(text) else np.full(at.shape, 0xFFFFFFFE, np.uint32)
    cell = np.broadcast_to(width - 1 - np.arange(width, dtype=np.int32), (len(low), width)).copy()
    for i in range(n):
        step = cell + ((near[:, i : i + width] != patterns[:, i, None]).astype(np.int32) << bits)
        np.minimum(step[:, :-1], cell[:, 1:] + one, out=step[:, :-1])
        step -= o
        cell = np.minimum.accumulate(step, axis=1) + o
    cost = cell >> bits
    j = cost.argmin(1)
    rows = np.arange(len(low))
    best = cell[rows, j]
    first, end = base + width - 1 - (best & (one - 1)), base + n + j
    return (best >> bits) <= budget, np.maximum(first, 0), np.minimum(end, len(text))


def spans_of(text: str | None, index: Index) -> Found:
    """Items found in text, and the merged places, in its own code points."""
    return index.search([text])[0]


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items, at most BLOCK_CHARS characters at a time; longer items are cut with an overlap of one window."""
    block, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null and item_id is not null").toLocalIterator():
        for at in range(0, max(1, len(r["text"])), BLOCK_CHARS - 4 * WINDOW):
            part = r["text"][at : at + BLOCK_CHARS]
            if block and size + len(part) > BLOCK_CHARS:
                yield block
                block, size = [], 0
            block.append((r["item_id"], part))
            size += len(part)
    if block:
        yield block


_cache: dict[int, Index] = {}
kept_in_tasks("index", _cache.clear)


def _index(shared) -> Index:
    """The index of one block, built where it is used; a worker holds one until it runs a task of another operator."""
    key, items = shared.value
    if key not in _cache:
        _cache.clear()
        _cache[key] = Index(items)
    return _cache[key]


def _searched(shared: list, groups: list[list]) -> list[list[Found]]:
    """What each group of texts holds, over all blocks."""
    out: list[list[Found]] = [[(set(), []) for _ in texts] for texts in groups]
    for s in shared:
        index = _index(s)
        for got, texts in zip(out, groups):
            for k, (items, spans) in enumerate(index.search(texts)):
                got[k] = (got[k][0] | items, got[k][1] + spans)
    return out


def _gathered(batches: Iterator[pa.RecordBatch], several: bool) -> Iterator[list[pa.RecordBatch]]:
    """Small parts, gathered up to GATHER bytes where there are several blocks."""
    held, size = [], 0
    for b in batches:
        for part in slices(b):
            held.append(part)
            size += part.nbytes
            if not several or size >= GATHER:
                yield held
                held, size = [], 0
    if held:
        yield held


def _shared(benchmark: DataFrame) -> list:
    """Every block as a broadcast of bounded size; Spark drops them when the plan that names them is gone."""
    context = benchmark.sparkSession.sparkContext
    return [context.broadcast((hash(tuple(b)), b)) for b in blocks(benchmark)]


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids (ascending) and spans (start:end) of every document."""
    shared = _shared(benchmark)

    def run(batches):
        for parts in _gathered(batches, len(shared) > 1):
            for part, found in zip(parts, _searched(shared, [p.column("text").to_pylist() for p in parts])):
                ids = [",".join(map(str, sorted(items))) for items, _ in found]
                places = [",".join(f"{a}:{b}" for a, b in spans) for _, spans in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([bool(i) for i, _ in found], pa.bool_()), pa.array([len(i) for i, _ in found], pa.int64()), pa.array(ids, pa.string()), pa.array(places, pa.string())],
                    names=["doc_id", "contaminated", "n_items", "item_ids", "spans"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda batches: tidied(run(batches), "index"), OUT)


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark passage, with their own columns."""
    shared = _shared(benchmark)

    def run(batches):
        for parts in _gathered(batches, len(shared) > 1):
            for part, found in zip(parts, _searched(shared, [p.column("text").to_pylist() for p in parts])):
                yield part.filter(pa.array([not items for items, _ in found], pa.bool_()))

    return docs.mapInArrow(lambda batches: tidied(run(batches), "index"), docs.schema)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
