"""Embedding near-dedup with spherical-cap filters.

A filter is a direction; a vector belongs to it if their inner product exceeds
a threshold.  Directions form a product code: a random rotation, then one of
`size` random codewords in each of several blocks, so the size**blocks
directions need no storage and each vector's filters are found by list decoding:
block by block, only the beginnings that can still reach the threshold go on.
The code grows with the number of vectors, in codewords and then in blocks, so
that a filter holds few unrelated ones, and a vector that exceeds the threshold
for few directions takes its best ones.  Narrower filters part near vectors more
often, so a vector's filters grow in number with the code and the chance of a
shared one stays (see README).

1. Equal vectors collapse first.  A row for each vector and filter carries a
   128-bit sign sketch, not the vector.
2. In filters of up to HOT members, the pairs whose sketches leave a link
   possible (a true link is dropped with probability below 1e-8) are candidates;
   repeats go, the vectors are joined once, and cosines in double precision
   decide.
3. Larger filters are dealt out as pairs of blocks of BLOCK members, with their
   vectors, and cosines decide there.  A link counts only if its ends share no
   smaller filter (one that step 2 compared, or a large one of smaller number),
   so it counts once; a block emits one row per member (its links and the root
   of its part), never its pairs.

Vectors that are null, empty, zero or hold null or non-finite components link
with nothing.  Only vectors of equal dimension can link.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.llm.common import discard, map_frames, materialize, read_table
from veinstone.llm.near_dedup import MOST_SENT, components

LINK = 0.9
#: A vector's filters, on average and at least, in codes of up to STEADY**3 filters; they grow as the power GROWTH of larger ones, and with blocks.
MEAN, LEAST = 36, 30
STEADY, GROWTH, MORE = 36, 0.55, 1.3
#: From so many codewords a block on, the code gets another block.
MOST_WORDS = 400
CROWD = 8
HOT, BLOCK = 64, 1024
_codes: dict = {}


def growth(size: int, blocks: int) -> float:
    """How many times MEAN filters a vector has in a code of size**blocks."""
    return max(1.0, size ** (blocks / 3) / STEADY) ** GROWTH * MORE ** (blocks - 3)


class Code:
    """The product code for one dimension, of size words in each of `blocks` blocks."""

    def __init__(self, dim: int, size: int, blocks: int = 3, seed: int = 17):
        rng = np.random.default_rng([seed, dim, size])
        self.rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        edges = np.linspace(0, dim, min(blocks, dim) + 1).astype(int)
        self.parts = list(zip(edges[:-1], edges[1:]))
        self.size = size
        self.least = round(LEAST * growth(size, blocks))
        self.words = []
        for a, b in self.parts:
            w = rng.normal(size=(size, b - a))
            self.words.append(w / np.linalg.norm(w, axis=1, keepdims=True) / np.sqrt(len(self.parts)))
        self.threshold = NormalDist().inv_cdf(1 - min(0.5, MEAN * growth(size, blocks) / float(size) ** len(self.parts))) / np.sqrt(dim)

    def decode(self, x: np.ndarray) -> list[np.ndarray]:
        """Ascending filter numbers of every row of x (unit vectors)."""
        y = x @ self.rotation
        scores = [y[:, a:b] @ w.T for (a, b), w in zip(self.parts, self.words)]
        every = self.size ** len(self.parts)
        out = []
        for row in zip(*scores):
            rest = np.append(np.cumsum([s.max() for s in row][::-1])[::-1][1:], 0.0)  # the most that later blocks can add
            threshold = self.threshold
            while True:
                name, value = np.zeros(1, np.int64), np.zeros(1)
                for s, more in zip(row, rest):
                    fits = s >= threshold - more - value.max()  # no beginning goes on with the other words
                    words = np.flatnonzero(fits)
                    sums = value[:, None] + s[words][None, :]
                    i, j = np.nonzero(sums >= threshold - more)
                    name, value = name[i] * self.size + words[j], sums[i, j]
                    if not len(name):
                        break
                if len(name) >= self.least or len(name) == every:
                    break
                threshold -= 0.1 * max(abs(self.threshold), 0.05)
            if threshold < self.threshold and len(name) > self.least:
                name = name[np.argsort(-value, kind="stable")[: self.least]]
            out.append(np.sort(name))
        return out


def _code(dim: int, size: int, blocks: int) -> Code:
    if (dim, size, blocks) not in _codes:
        _codes[dim, size, blocks] = Code(dim, size, blocks)
    return _codes[dim, size, blocks]


def code_size(n: int) -> tuple[int, int]:
    """(codewords a block, blocks) for n vectors: about CROWD unrelated vectors in a filter."""
    blocks = 3
    while True:
        for size in range(6, MOST_WORDS + 1):
            if float(size) ** blocks * CROWD >= n * MEAN * growth(size, blocks):
                return size, blocks
        blocks += 1


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, key (128-bit hash of the components; null if it can't link) and the components as doubles."""

    def run(batches):
        for b in batches:
            keys, raw = [], []
            for e in b["embedding"]:
                x = None if e is None else np.array([np.nan if v is None else v for v in e] if getattr(e, "dtype", None) == object else e, np.float64)
                if x is None or not len(x) or not np.isfinite(x).all() or not x.any():
                    keys.append(None)
                    raw.append(None)
                    continue
                x = x / np.abs(x).max() + 0.0  # no overflow in the norm; -0.0 becomes 0.0
                raw.append((x / np.linalg.norm(x)).tobytes())
                keys.append(xxhash.xxh3_128_digest(np.asarray(e, np.float64).tobytes()))
            yield pd.DataFrame({"vec_id": b["vec_id"], "key": keys, "unit": raw})

    return map_frames(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), run, "vec_id long, key binary, unit binary")


def _by_dimension(units: pd.Series):
    """(rows, matrix) for each dimension that occurs."""
    size = units.map(len).to_numpy()
    for s in np.unique(size):
        rows = np.flatnonzero(size == s)
        yield rows, np.frombuffer(b"".join(units.iloc[rows]), np.float64).reshape(len(rows), -1)


def _number(lists: list[np.ndarray], dim: int) -> np.ndarray:
    """Filters of different dimensions are different."""
    return np.concatenate(lists) ^ (dim << 44)


def sketches(x: np.ndarray, seed: int = 23) -> np.ndarray:
    """Signs of 128 random directions of every row, as two 64-bit numbers."""
    bits = x @ np.random.default_rng([seed, x.shape[1]]).normal(size=(x.shape[1], 128)) >= 0
    return np.packbits(bits, axis=1).view(np.int64)


def most_bits(link: float) -> int:
    """Signs in which the sketches of a link may differ: six standard deviations above the mean."""
    p = math.acos(min(1.0, max(-1.0, link))) / math.pi
    return math.ceil(128 * p + 6 * math.sqrt(128 * p * (1 - p)))


def filters(nodes: DataFrame, code: tuple[int, int]) -> DataFrame:
    """A row for each node and filter, with the node's sketch."""

    def run(batches):
        for b in batches:
            for rows, x in _by_dimension(b["unit"]) if len(b) else ():
                lists = _code(x.shape[1], *code).decode(x)
                take = np.repeat(np.arange(len(rows)), [len(f) for f in lists])
                signs = sketches(x)
                yield pd.DataFrame({"filter": _number(lists, x.shape[1]), "nid": b["nid"].to_numpy(np.int64)[rows][take], "s0": signs[take, 0], "s1": signs[take, 1]})

    return map_frames(nodes.select("nid", "unit"), run, "filter long, nid long, s0 long, s1 long")


def near_pairs(rows: DataFrame, most: int) -> DataFrame:
    """(a, b), a < b: members of a filter whose sketches differ in `most` bits at most; rows are sorted by filter in their partitions."""

    def run(batches):
        rest = None
        for b in batches:
            rest = b if rest is None else pd.concat([rest, b], ignore_index=True)
            key = rest["filter"].to_numpy(np.int64)
            whole = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last filter may go on
            yield pairs(rest.iloc[:whole])
            rest = rest.iloc[whole:]
        if rest is not None:
            yield pairs(rest)

    def pairs(rows: pd.DataFrame) -> pd.DataFrame:
        key, nid, s0, s1 = (rows[c].to_numpy(np.int64) for c in ("filter", "nid", "s0", "s1"))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for d in range(1, HOT + 1):  # neighbours in a filter, then the next but one ...
            i = np.flatnonzero(key[d:] == key[:-d])
            if not len(i):
                break
            bits = sum(np.bitwise_count((s[i] ^ s[i + d]).view(np.uint64)).astype(np.int64) for s in (s0, s1))
            i = i[bits <= most]
            a.append(nid[i])
            b.append(nid[i + d])
        a, b = np.concatenate(a), np.concatenate(b)
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    return map_frames(rows.select("filter", "nid", "s0", "s1"), run, "a long, b long", 1 << 16)


def confirmed(pairs: DataFrame, nodes: DataFrame, link: float) -> DataFrame:
    """(a, b, ta, tb): the pairs whose vectors link, with how many rows each stands for."""

    def run(batches):
        for b in batches:
            keep = np.zeros(len(b), bool)
            same = (b["ua"].map(len) == b["ub"].map(len)).to_numpy(bool)
            for rows, x in _by_dimension(b["ua"][same]) if same.any() else ():
                rows = np.flatnonzero(same)[rows]
                y = np.frombuffer(b"".join(b["ub"].iloc[rows]), np.float64).reshape(len(rows), -1)
                keep[rows] = np.einsum("ij,ij->i", x, y) >= link
            yield b.loc[keep, ["a", "b", "ta", "tb"]]

    left = nodes.select(F.col("nid").alias("a"), F.col("times").alias("ta"), F.col("unit").alias("ua"))
    right = nodes.select(F.col("nid").alias("b"), F.col("times").alias("tb"), F.col("unit").alias("ub"))
    return map_frames(pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb", "ua", "ub"), run, "a long, b long, ta long, tb long", 4096)


def _bucket(group: pd.DataFrame, crossed: bool, link: float) -> pd.DataFrame | None:
    """Links and roots of one filter's members; crossed: only links between its two sides count."""
    x = np.frombuffer(b"".join(group["unit"]), np.float64).reshape(len(group), -1)
    near = x @ x.T >= link
    np.fill_diagonal(near, False)
    if crossed:
        side = group["side"].to_numpy()
        near &= side[:, None] != side[None, :]
    if not near.any():
        return None
    here = group["filter"].iloc[0]
    lists = []
    for every, hot in zip(group["filters"], group["hot"]):
        every = np.frombuffer(every, np.int64)
        lists.append(every[~np.isin(every, hot) | (every < here)])  # where the pair is compared before
    member = np.repeat(np.arange(len(lists)), [len(f) for f in lists])
    earlier, column = np.unique(np.concatenate(lists), return_inverse=True)
    met = np.zeros((len(lists), max(1, len(earlier))), np.float32)
    met[member, column] = 1
    first = near & (met @ met.T == 0)
    if not first.any():
        return None
    root = np.arange(len(group))
    while True:
        new = np.where(first, root[None, :], len(group)).min(1)
        new = np.minimum(root, new)
        new = new[new]
        if (new == root).all():
            break
        root = new
    nid, times = group["nid"].to_numpy(), group["times"].to_numpy()
    used = first.any(1)
    return pd.DataFrame({"nid": nid[used], "links": (first @ times)[used], "root": nid[root[used]]})


def bucket_links(rows: DataFrame, link: float) -> DataFrame:
    """(nid, links, root) parts from rows sorted by bucket within their partitions."""

    def run(batches):
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            rest = None
            if not len(b):
                continue
            key = b[["filter", "low", "high"]].to_numpy()
            cut = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            bounds = np.concatenate([[0], cut])
            rest = b.iloc[bounds[-1] :]
            parts = [p for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()) if e - s > 1 and (p := _bucket(b.iloc[s:e], bool(key[s, 1] != key[s, 2]), link)) is not None]
            if parts:
                yield pd.concat(parts)
        if rest is not None and len(rest) > 1 and (p := _bucket(rest, bool(rest["low"].iloc[0] != rest["high"].iloc[0]), link)) is not None:
            yield p

    return rows.mapInPandas(run, "nid long, links long, root long")


def hot_links(rows: DataFrame, hot: DataFrame, nodes: DataFrame, code: tuple[int, int], link: float) -> DataFrame:
    """(nid, links, root) parts from the filters of more than HOT members."""

    def run(batches):
        for b in batches:
            for at, x in _by_dimension(b["unit"]) if len(b) else ():
                lists = _code(x.shape[1], *code).decode(x)
                yield b.iloc[at].assign(filters=[(f ^ (x.shape[1] << 44)).tobytes() for f in lists])

    members = materialize(rows.join(hot, "filter").select("filter", "nid", "blocks"), "hot-members")
    mine = members.groupBy("nid").agg(F.collect_list("filter").alias("hot"))
    packed = map_frames(nodes.select("nid", "times", "unit").join(mine.select("nid"), "nid", "left_semi"), run, "nid long, times long, unit binary, filters binary").join(mine, "nid")
    dealt = members.withColumn("side", F.pmod(F.xxhash64("nid"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("filter", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "nid").join(packed, "nid")
    return bucket_links(dealt.repartition("filter", "low", "high").sortWithinPartitions("filter", "low", "high"), link)


def near_vectors(vectors: DataFrame, link: float = LINK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    known = materialize(usable(vectors), "vectors")
    grouped = known.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("times"), F.min("unit").alias("unit"))
    nodes = materialize(grouped.select(F.monotonically_increasing_id().alias("nid"), "key", "vec_id", "times", "unit"), "vector-nodes")
    code = code_size(nodes.count())

    rows = materialize(filters(nodes, code), "vector-filters")
    sizes = rows.groupBy("filter").agg(F.count(F.lit(1)).alias("n"))
    hot = materialize(sizes.where(F.col("n") > HOT).select("filter", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "hot-filters")
    n_hot = hot.count()
    sent = F.broadcast(hot) if n_hot <= MOST_SENT else hot
    cold = rows.join(sent, "filter", "left_anti") if n_hot else rows
    pairs = near_pairs(cold.repartition("filter").sortWithinPartitions("filter"), most_bits(link)).distinct()
    links = materialize(confirmed(pairs, nodes, link), "vector-links")
    counts = links.select(F.col("a").alias("nid"), F.col("tb").alias("links")).unionByName(links.select(F.col("b").alias("nid"), F.col("ta").alias("links")))
    edges = links.select("a", "b")
    if n_hot:
        parts = materialize(hot_links(rows, sent, nodes, code, link), "hot-links")
        counts = counts.unionByName(parts.select("nid", "links"))
        edges = edges.unionByName(parts.where("nid <> root").select(F.col("root").alias("a"), F.col("nid").alias("b")))
    discard(rows)
    links = counts.groupBy("nid").agg(F.sum("links").alias("links"))
    labels = components(edges)
    named = nodes.select("nid", "key", "vec_id", "times").join(links, "nid", "left").join(labels, "nid", "left").withColumn("label", F.coalesce("label", "nid"))
    least = named.groupBy("label").agg(F.min("vec_id").alias("component_id"))
    by_key = named.join(least, "label").select("key", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id")
    out = known.select("vec_id", "key").join(by_key, "key", "left")
    component_id = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), F.coalesce(F.col("vec_id") == component_id, F.lit(False)).alias("kept"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"))


#: The same in DuckDB's SQL, by the cosines of all pairs: for small tables only.
ORACLE = """
WITH RECURSIVE
v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.y FROM reach r JOIN links l ON r.b = l.x),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT x, count(*) AS k FROM links GROUP BY x)
SELECT e.vec_id, coalesce(n.k, 0) AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e LEFT JOIN n ON n.x = e.vec_id JOIN least l ON l.a = e.vec_id
"""
