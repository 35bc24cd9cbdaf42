"""Best-fit packing of token sequences by a configuration linear program.

A configuration is a multiset of piece lengths that fits one sequence.  Only
the histogram of lengths (at most one row per length up to the sequence
length, whatever the input) comes to the driver.

1. Neighbouring lengths (within WIDTH of each other) form classes that count as
   their longest member, so that counts are large against the configurations.
2. The covering program "fewest sequences whose configurations hold every
   piece" is solved by multiplicative weights: prices fall as a class is
   covered, a knapsack dynamic program finds the configuration worth most at
   these prices, and the prices over that worth bound the program from below.
   It stops when cover and bound differ by GAP, however many rounds that takes;
   where a step size can't reach it, the next one is half as large.
3. Multiplicities are rounded: whole parts first, then the largest remainders,
   as far as pieces last.  A rounded configuration is filled with the longest
   members of its classes and, last, the longest piece that still fits.
4. The pieces left are a smaller instance of the same program.  When a pass
   leaves more than STALL of them, best fit decreasing puts the rest into the
   space that is left and into new sequences.

Pieces are then dealt to the configurations' places by their rank among the
pieces of their length: a prefix sum over per-task counts, so no task ever
holds all pieces of a common length, and the counts meet the pieces in a
shuffled join, so nothing that grows is broadcast.

Null and empty texts are one piece of one token (the end id).  Repeated rows
and null ids are packed like any other row: nothing is joined by doc_id.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veinstone.llm.common import map_frames, materialize, read_table
from veinstone.llm.tokenizing import word_encoder

LENGTH = 2048
END_ID = 0
#: Lengths of a class differ by so much of the shortest; the cover's distance from its bound; the share that a pass may leave.
WIDTH, GAP, STALL = 0.01, 0.02, 0.7
#: A class waits if it holds less than so much of the mean class's tokens.  Where a cover may be cut off, as shares of the classes.
LIGHT, LEVELS = 0.05, (0, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5)
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, pid int, lrank long"
OUT = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def knapsack(lengths: np.ndarray, values: np.ndarray, capacity: int) -> np.ndarray:
    """How often each length is in the configuration of greatest total value.

    Dynamic program over the capacity, a length at a time; one, two, four and
    more copies of a length together make any number of it.
    """
    best = np.zeros(capacity + 1)
    steps = []
    for i, (size, value) in enumerate(zip(lengths.tolist(), values.tolist())):
        copies = 1
        while size <= capacity:
            more = best[:-size] + value
            steps.append((i, copies, size, more > best[size:]))
            np.maximum(best[size:], more, out=best[size:])
            size, value, copies = 2 * size, 2 * value, 2 * copies
    out = np.zeros(len(lengths), np.int64)
    c = capacity
    for i, copies, size, better in reversed(steps):
        if c >= size and better[c - size]:
            out[i] += copies
            c -= size
    return out


def classes(lengths: np.ndarray) -> np.ndarray:
    """The class of each of the ascending lengths: members differ by WIDTH of the shortest at most."""
    out, first = [], None
    for k in lengths.tolist():
        if first is None or k > first + int(WIDTH * first):
            first = k
            out.append(out[-1] + 1 if out else 0)
        else:
            out.append(out[-1])
    return np.array(out, np.int64)


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int, gap: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(configurations as columns, their multiplicities, lower bound): a cover of counts within `gap` of the bound.

    Each step takes all configurations at hand that are worth almost as much as
    the best, as often as no class is covered more than once over; only when
    none is left does the dynamic program price a new one.  What the cover
    lacks of a class counts as sequences of that class alone.
    """
    found, unit = np.zeros((len(lengths), 64)), np.zeros(64)
    known: dict[bytes, int] = {}
    bound, step = 0.0, 0.5
    while True:
        times, cover, price, worth = np.zeros(found.shape[1]), np.zeros(len(lengths)), lengths / capacity, np.inf
        for turn in itertools.count(1):
            value = price @ found[:, : len(known)]
            if not known or value.max() < (1 - step / 4) * worth:
                a = knapsack(lengths, price, capacity)
                worth = float(price @ a)
                bound = max(bound, float(counts @ price) / worth)
                if a.tobytes() not in known:
                    if len(known) == found.shape[1]:
                        found, unit, times = np.concatenate([found, np.zeros_like(found)], axis=1), np.concatenate([unit, np.zeros_like(unit)]), np.concatenate([times, np.zeros_like(times)])
                    used = a > 0
                    found[:, len(known)], unit[len(known)] = a, (counts[used] / a[used]).min()
                    known[a.tobytes()] = len(known)
                value = price @ found[:, : len(known)]
            best = np.flatnonzero(value >= (1 - step / 4) * worth)
            more = found[:, best] @ unit[best] / counts
            part = 1 / more.max()
            times[best] += part * unit[best]
            cover += part * more
            price *= np.exp(-step * part * more)
            if turn % 16 == 0:
                scale = 1 / price.max()
                price, worth = price * scale, worth * scale
                level = np.unique(np.quantile(cover, LEVELS))
                level = level[level > 0]
                if len(level):
                    cost = times.sum() / level + (counts * np.maximum(0, 1 - cover / level[:, None]) / (capacity // lengths)).sum(1)
                    k = int(cost.argmin())
                    if cost[k] <= (1 + gap) * bound:
                        return found[:, : len(known)].astype(np.int64), times[: len(known)] / level[k], bound
                    if level[k] >= np.log(len(lengths) + 1) / step**2:
                        break
        step /= 2


class _Left:
    """The pieces not placed yet, by length."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray):
        self.lengths, self.counts = lengths, counts.copy()

    def longest(self, limit: int, taken: dict[int, int]) -> int | None:
        """The place of the longest length up to limit of which a piece is left."""
        k = int(np.searchsorted(self.lengths, limit, "right")) - 1
        while k >= 0 and self.counts[k] <= taken.get(k, 0):
            k -= 1
        return k if k >= 0 else None


def filled(slots: list[tuple[int, int]], times: int, left: _Left, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Up to `times` sequences with a piece for each slot (shortest, longest), given from long to short; groups of equal ones."""
    out = []
    while times:
        taken: dict[int, int] = {}
        space = capacity
        for n, (low, high) in enumerate(slots):
            k = left.longest(space if n == len(slots) - 1 else high, taken)
            if k is None or left.lengths[k] < low:
                return out
            taken[k] = taken.get(k, 0) + 1
            space -= int(left.lengths[k])
        each = min(times, *(int(left.counts[k]) // n for k, n in taken.items()))
        for k, n in taken.items():
            left.counts[k] -= n * each
        out.append(({int(left.lengths[k]): n for k, n in taken.items()}, each))
        times -= each
    return out


def rounded(left: _Left, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Whole sequences from the program over what is left, taken off it.

    Classes that hold hardly any of the tokens would slow all others down; they
    wait until less is left.
    """
    used = left.counts > 0
    lengths, counts = left.lengths[used], left.counts[used]
    group = classes(lengths)
    edge = np.flatnonzero(np.diff(group)) + 1
    low, high = lengths[np.concatenate([[0], edge])], lengths[np.concatenate([edge, [len(lengths)]]) - 1]
    mass = np.bincount(group, counts * lengths)
    heavy = mass * len(mass) >= LIGHT * mass.sum()
    low, high = low[heavy], high[heavy]
    configurations, times, _ = fractional(high, np.bincount(group, counts)[heavy], capacity, GAP)
    order = np.argsort(-times, kind="stable")
    whole = np.floor(times + 1e-9).astype(np.int64)
    out = []
    for part in (order, order[np.argsort(-(times - whole)[order], kind="stable")]):
        for j in part.tolist():
            n = int(whole[j]) if part is order else int(times[j] - whole[j] > 1e-9)
            slots = [(int(low[i]), int(high[i])) for i in np.flatnonzero(configurations[:, j])[::-1].tolist() for _ in range(int(configurations[i, j]))]
            if n and slots:
                out += filled(slots, n, left, capacity)
    return out


def best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int, opened: list[tuple[dict[int, int], int]] = ()) -> list[tuple[dict[int, int], int]]:
    """Best fit decreasing on a histogram, into opened sequences too: groups of equal sequences stay one entry."""
    space: list[list] = [[] for _ in range(capacity + 1)]
    for config, times in opened:
        space[capacity - sum(k * n for k, n in config.items())].append((config, times))
    for length, n in sorted(zip(lengths.tolist(), counts.tolist()), reverse=True):
        at = length
        while n:
            while at <= capacity and not space[at]:
                at += 1
            if at > capacity:
                each = capacity // length
                for k, times in ((each, n // each), (n % each, 1)):
                    if k and times:
                        space[capacity - k * length].append(({length: k}, times))
                break
            config, times = space[at].pop()
            k = min(n, times)
            if times > k:
                space[at].append((config, times - k))
            space[at - length].append((config | {length: config.get(length, 0) + 1}, k))
            n -= k
            at = max(length, at - length)
    return [x for group in space for x in group]


def plan(histogram: dict[int, int], capacity: int = LENGTH) -> tuple[list[tuple[dict[int, int], int]], dict[str, int]]:
    """Configurations {length: times} and how many sequences each has, covering the histogram exactly.

    Beside them, the tokens of pieces shorter than a sequence, and how many of
    these rounded configurations placed.
    """
    out = [({capacity: 1}, histogram[capacity])] if histogram.get(capacity) else []
    lengths = np.array(sorted(k for k, n in histogram.items() if n and k < capacity), np.int64)
    left = _Left(lengths, np.array([histogram[k] for k in lengths.tolist()], np.int64))
    tokens = int(lengths @ left.counts)
    made: list[tuple[dict[int, int], int]] = []
    rest = tokens
    while rest:
        made += rounded(left, capacity)
        before, rest = rest, int(lengths @ left.counts)
        if rest > STALL * before:
            break
    used = left.counts > 0
    made = best_fit(lengths[used], left.counts[used], capacity, made)
    return out + made, {"tokens": tokens, "by_program": tokens - rest}


def places(configs: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank, times in a sequence, first sequence and first offset of each configuration that holds it."""
    out: dict[int, list] = {}
    sequence = 0
    taken: dict[int, int] = {}
    for config, times in configs:
        offset = 0
        for length in sorted(config, reverse=True):
            out.setdefault(length, []).append((taken.get(length, 0), config[length], sequence, offset))
            taken[length] = taken.get(length, 0) + times * config[length]
            offset += length * config[length]
        sequence += times
    return {k: tuple(np.array(v, np.int64).T) for k, v in out.items()}


def tokenize_pieces(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """Pieces of every document; lrank counts the pieces of a length in a task."""

    def run(batches):
        encoder = word_encoder(path)
        seen: dict[int, int] = {}
        pid = TaskContext.get().partitionId()
        end = np.array([END_ID], "<u4").tobytes()
        for b in batches:
            rows = []
            for doc_id, raw in zip(b["doc_id"].tolist(), encoder.ids_bytes([t if isinstance(t, str) else "" for t in b["text"]])):
                raw += end
                for piece, at in enumerate(range(0, len(raw), 4 * length)):
                    part = raw[at : at + 4 * length]
                    n = len(part) // 4
                    k = seen.get(n, 0)
                    seen[n] = k + 1
                    rows.append((doc_id, piece, at // 4, n, zlib.crc32(part), pid, k))
            if rows:
                out = pd.DataFrame(rows, columns=[x.split()[0] for x in PIECES.split(", ")])
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out

    return map_frames(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, PIECES)


def pack(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """One row per piece with its place: see the module's text."""
    pieces = materialize(tokenize_pieces(docs, path, length), "pieces")
    counts = pieces.groupBy("length", "pid").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialize(counts.select("length", "pid", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row per length, 2048 at most
    table = places(plan(histogram, length)[0])

    def place(batches):
        for b in batches:
            n, rank = b["length"].to_numpy(np.int64), b["rank"].to_numpy(np.int64)
            sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for value in np.unique(n).tolist():
                rows = np.flatnonzero(n == value)
                first, times, base, start = table[value]
                j = np.searchsorted(first, rank[rows], side="right") - 1
                k = rank[rows] - first[j]
                sequence[rows] = base[j] + k // times[j]
                offset[rows] = start[j] + k % times[j] * value
            yield b.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    ranked = pieces.join(counts.select("length", "pid", "base").hint("merge"), ["length", "pid"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("lrank")).alias("rank"))
    return map_frames(ranked, place, OUT)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
