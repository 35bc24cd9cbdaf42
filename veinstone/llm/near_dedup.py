"""MinHash near-dedup on SetSketch registers.

Every element of a set runs a Poisson process whose points fall on registers;
a register keeps its earliest point on an exponential scale.  Registers of
equal sets are equal, sketches merge by maximum, and two sets' registers agree
with about the probability of their Jaccard similarity.

1. One pass sketches every whole text.  Equal sets collapse to one node.
2. Bands of register values make buckets.  Candidates are the pairs of small
   buckets and, in large ones, the links of all members to one hub.  The keys of
   large buckets are few and go to the rows; a hub's pairs are dealt out in
   parts of SPLIT, its values copied to each part, so no key is one task's.
3. A candidate must pass the joint likelihood of its two sketches (set sizes
   known); then the full shingle sets decide.  Large buckets that still hold
   more than one component are compared whole, in blocks of at most two times
   BLOCK members: first by sketches, which leave those members that may link to
   another component, then by the full sets of these, intersected in one matrix
   product.  A block returns a spanning forest, never its pairs.  So no link is
   lost but those that the likelihood (DOUBT) takes for impossible: it keeps a
   true link with all but about exp(-DOUBT) of its probability.
4. Components are the fixed point of min-label propagation with pointer
   jumping; labels never come to the driver.

Null or empty texts have no shingle and link with nothing.  Rows that share a
doc_id with different texts are different nodes; equal rows stay equal rows.
A null doc_id is linked like any other but never names a component.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.llm.common import discard, map_frames, materialize, read_table, tidied
from veinstone.llm.shingles import mix, shingle_sets

BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
BASE, SCALE, TOP = 1.001, 20.0, 65_535
#: A candidate goes only if the least linked similarity or more is exp(-14) less likely than the best similarity.
DOUBT = 14.0
SMALL_BUCKET = 8
#: Up to so many ids (8 bytes each) are broadcast, so that texts needn't be shuffled; beyond, a shuffled join does the same.
MOST_SENT = 2_000_000
BLOCK = 1024
SPLIT = 1024


def sketch(elements: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """The set's registers, uint16."""
    n = len(elements)
    registers = np.full(m, np.inf)
    limit = (math.log(m) + 7.0) / n
    while True:
        block = int(min(1024, max(4, 2 ** math.ceil(math.log2(m * limit * 1.2)))))
        step = 0
        ids, t = elements, np.zeros(n)
        while len(ids):
            k = np.arange(step, step + block, dtype=np.uint64)
            bits = mix(ids[:, None] + (k + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
            u = ((bits >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52
            times = t[:, None] + np.cumsum(-np.log(u), axis=1) / m
            spot = (mix(bits) >> np.uint64(40)).astype(np.int64) % m
            ok = times <= limit
            np.minimum.at(registers, spot[ok], times[ok])
            go_on = ok[:, -1]
            ids, t, step = ids[go_on], times[go_on, -1], step + block
        if np.isfinite(registers).all():
            break
        limit *= 2
    return np.clip(np.floor(1 + (math.log(SCALE) - np.log(registers)) / math.log(BASE)), 0, TOP).astype("<u2")


def band_keys(registers: np.ndarray) -> np.ndarray:
    """int64 bucket keys of sketches, a row each."""
    x = registers.reshape(len(registers), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), x.shape[:2])
    for r in range(ROWS):
        key = mix(key + x[:, :, r] + np.uint64(1))
    return key.view(np.int64)


def plausible(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, least: float) -> np.ndarray:
    """Whether the registers' order statistics leave a similarity of `least` or more possible."""
    m = a.shape[1]
    above, below = (a > b).sum(1).astype(float), (a < b).sum(1).astype(float)
    same = m - above - below
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    log_b, most = math.log(BASE), np.minimum(u, v) / np.maximum(u, v)

    def likelihood(j):
        j = np.minimum(j, most)  # a larger similarity is impossible for these sizes
        p = lambda x: np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / log_b, 1e-12, 1)
        up, down = p(u - v * j), p(v - u * j)
        return above * np.log(up) + below * np.log(down) + same * np.log(np.clip(1 - up - down, 1e-12, 1))

    grid = np.linspace(0, 1, 41)
    values = np.array([likelihood(np.full(len(u), g)) for g in grid])
    return (most >= least - 1e-12) & (values[grid >= least - 1e-9].max(0) >= values.max(0) - DOUBT)


def signatures(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_id (128-bit hash of the set; null if empty) and registers."""

    def run(batches):
        for b in batches:
            sets = shingle_sets([t if isinstance(t, str) else "" for t in b["text"]], width)
            known: dict[bytes, bytes] = {}
            ids, regs = [], []
            for s in sets:
                if not len(s):
                    ids.append(None)
                    regs.append(None)
                    continue
                key = xxhash.xxh3_128_digest(s.tobytes())
                if key not in known:
                    known[key] = sketch(s).tobytes()
                ids.append(key)
                regs.append(known[key])
            yield pd.DataFrame({"doc_id": b["doc_id"], "text_hash": b["text_hash"], "n_shingles": [len(s) for s in sets], "set_id": ids, "registers": regs})

    return map_frames(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")), run, "doc_id long, text_hash long, n_shingles long, set_id binary, registers binary")


def _bands(nodes: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            if len(b):
                keys = band_keys(np.frombuffer(b"".join(b["registers"]), "<u2").reshape(len(b), REGISTERS))
                yield pd.DataFrame({"key": keys.ravel(), "nid": np.repeat(b["nid"].to_numpy(np.int64), BANDS)})

    return map_frames(nodes.select("nid", "registers"), run, "key long, nid long")


def _rows_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """At least the rows of docs whose ids are among the nodes': the others needn't be shuffled."""
    ids = nodes.select("doc_id").where("doc_id is not null").distinct()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if ids.count() > MOST_SENT:
        return docs
    return docs.join(F.broadcast(ids), "doc_id", "left_semi").unionByName(docs.where(F.col("doc_id").isNull()))


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """Full shingle sets of the wanted nodes, from the text that stands for each.

    The join is on id and text hash, so ids that repeat or are null make no pairs.
    """

    def run(batches):
        for b in batches:
            sets = shingle_sets(b["text"].tolist(), width)
            keep = [xxhash.xxh3_128_digest(s.tobytes()) == bytes(k) for s, k in zip(sets, b["set_id"])]
            yield pd.DataFrame({"nid": b["nid"], "elements": [s.tobytes() for s in sets]})[keep]

    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).join(wanted, F.col("doc_id").eqNullSafe(F.col("w_doc_id")) & (F.col("text_hash") == F.col("w_text_hash")))
    return map_frames(joined.select("nid", "set_id", "text"), run, "nid long, elements binary").dropDuplicates(["nid"])


def _sent(df: DataFrame) -> DataFrame:
    """df to be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= MOST_SENT else df


def _met(pairs: DataFrame, values: DataFrame, columns: list[str]) -> DataFrame:
    """pairs (a, b) with the columns of both ends, as a_ and b_; the pairs of one a are dealt out in parts."""
    stars = materialize(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SPLIT).select("a", F.ceil(F.col("n") / SPLIT).cast("int").alias("parts")), "stars")
    left = values.select(F.col("nid").alias("a"), *[F.col(c).alias("a_" + c) for c in columns])
    right = values.select(F.col("nid").alias("b"), *[F.col(c).alias("b_" + c) for c in columns])
    sent, parts = _sent(stars), F.coalesce("parts", F.lit(1))
    left = left.join(sent, "a", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    dealt = pairs.join(sent, "a", "left").withColumn("part", F.pmod(F.xxhash64("b"), parts).cast("int")).drop("parts")
    return dealt.join(left, ["a", "part"]).join(right, "b").drop("part")


def _estimate(pairs: DataFrame, candidates: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sketches leave a link possible."""

    def run(batches):
        for b in batches:
            if len(b):
                x, y = (np.frombuffer(b"".join(b[c]), "<u2").reshape(len(b), REGISTERS) for c in ("a_registers", "b_registers"))
                yield b.loc[plausible(x, y, b["a_n_shingles"].to_numpy(float), b["b_n_shingles"].to_numpy(float), percent / 100), ["a", "b"]]

    return map_frames(_met(pairs, candidates, ["n_shingles", "registers"]), run, "a long, b long", 4096)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs that the full sets confirm."""

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b["a_elements"], b["b_elements"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.loc[keep, ["a", "b"]]

    return map_frames(_met(pairs, sets, ["elements"]), run, "a long, b long")


def _block_links(rows: DataFrame, percent: int) -> DataFrame:
    """Links that join up each block's members, from exact intersections of their full sets.

    Rows are sorted by block.  Elements of one member only can't be shared and
    are left out; a block's links come back as a spanning forest, a row per
    member at most, never as its pairs.
    """

    def block(group: pd.DataFrame):
        sets = [np.frombuffer(e, np.uint64) for e in group["elements"]]
        size = np.array([len(x) for x in sets], np.float32)
        member = np.repeat(np.arange(len(sets)), size.astype(np.int64))
        _, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = df[column] > 1
        member, column = member[shared], np.cumsum(df > 1)[column[shared]] - 1
        order = np.argsort(column, kind="stable")
        member, column = member[order], column[order]
        both = np.zeros((len(sets), len(sets)), np.float32)
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            a, b = np.searchsorted(column, [at, at + 4096])
            part = np.zeros((len(sets), 4096), np.float32)
            part[member[a:b], column[a:b] - at] = 1
            both += part @ part.T  # counts below 2**24 are exact
        near = 100 * both >= percent * (size[:, None] + size[None, :] - both)
        side = group["side"].to_numpy()
        if group["low"].iloc[0] != group["high"].iloc[0]:
            near &= side[:, None] != side[None, :]
        np.fill_diagonal(near, True)
        root = np.arange(len(sets))
        while True:
            new = np.where(near, root[None, :], len(sets)).min(1)
            new = new[new]
            if (new == root).all():
                break
            root = new
        # A root is reachable, though perhaps not linked directly: its component is what counts.
        nid = group["nid"].to_numpy()
        moved = root != np.arange(len(sets))
        return pd.DataFrame({"a": np.minimum(nid[root], nid)[moved], "b": np.maximum(nid[root], nid)[moved]})

    return rows.mapInPandas(lambda batches: tidied(map(block, _blocks(batches))), "a long, b long")


def _blocks(batches):
    """The blocks of rows sorted by (key, low, high), each whole."""
    rest = None
    for b in batches:
        b = b if rest is None else pd.concat([rest, b], ignore_index=True)
        rest = b if len(b) else None
        if not len(b):
            continue
        key = b[["key", "low", "high"]].to_numpy()
        bounds = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist()]
        rest = b.iloc[bounds[-1] :]
        yield from (b.iloc[s:e] for s, e in zip(bounds[:-1], bounds[1:]))
    if rest is not None and len(rest):
        yield rest


def _may_link(rows: DataFrame, percent: int) -> DataFrame:
    """(key, low, high, side, nid) of the members of each block whose sketches leave a link to another component possible."""

    least = percent / 100
    #: Registers agree with about the similarity's probability: fewer than eight deviations below say no.
    agreeing = REGISTERS * least - 8 * math.sqrt(REGISTERS * least * (1 - least))

    def block(group: pd.DataFrame):
        x = np.frombuffer(b"".join(group["registers"]), "<u2").reshape(len(group), REGISTERS)
        n, label, side = group["n_shingles"].to_numpy(float), group["label"].to_numpy(), group["side"].to_numpy()
        crossed = group["low"].iloc[0] != group["high"].iloc[0]
        found = np.zeros(len(group), bool)
        for at in range(0, len(group), 256):
            part = slice(at, at + 256)
            near = label[part, None] != label
            if crossed:
                near &= side[part, None] != side
            if near.any():
                same = np.zeros(near.shape, np.uint8)
                for r in range(REGISTERS):
                    same += x[part, r, None] == x[:, r]
                i, j = np.nonzero(near & (same >= agreeing))
                for k in range(0, len(i), 1 << 16):
                    a, b = i[k : k + (1 << 16)] + at, j[k : k + (1 << 16)]
                    ok = plausible(x[a], x[b], n[a], n[b], least)
                    found[a[ok]] = found[b[ok]] = True
        return group.loc[found, ["key", "low", "high", "side", "nid"]]

    return rows.mapInPandas(lambda batches: tidied(map(block, _blocks(batches))), "key long, low int, high int, side int, nid long")


def components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(nid, label) of every linked node; label is the smallest node reachable.

    Each round takes the smallest label among a node and its neighbours, then
    jumps to that label's label, so the rounds grow with the logarithm of a
    component's diameter.  Partial aggregation folds a hub's many neighbours
    before the shuffle.
    """
    both = materialize(links.select(F.col("a").alias("nid"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("nid"), F.col("a").alias("other"))), "edges")
    state = materialize(both.groupBy("nid").agg(F.least(F.min("other"), F.first("nid")).alias("label")), "labels")
    while True:
        near = both.join(state.select(F.col("nid").alias("other"), "label"), "other").groupBy("nid").agg(F.min("label").alias("near"))
        hop = state.join(near, "nid").select("nid", "label", F.least("label", "near").alias("now"))
        jump = hop.join(state.select(F.col("nid").alias("now"), F.col("label").alias("far")), "now", "left")
        new = materialize(jump.select("nid", F.least("now", F.coalesce("far", "now")).alias("label"), (F.least("now", F.coalesce("far", "now")) < F.col("label")).alias("changed")), "labels")
        discard(state)
        state = new
        if state.where("changed").isEmpty():
            discard(both)
            return state.select("nid", "label")


def _labelled(docs: DataFrame, percent: int, width: int) -> tuple[DataFrame, DataFrame]:
    """Every document's signature, and (set_id, doc_id, text_hash, label) of every distinct set."""
    signed = materialize(signatures(docs, width), "signatures")
    grouped = signed.where("n_shingles > 0").groupBy("set_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("d"), F.min(F.struct("registers", "n_shingles")).alias("s"))
    nodes = materialize(grouped.select(F.monotonically_increasing_id().alias("nid"), "set_id", "d.doc_id", "d.text_hash", "s.n_shingles", "s.registers"), "nodes")

    bands = materialize(_bands(nodes), "bands")
    sizes = bands.groupBy("key").agg(F.min("nid").alias("hub"), F.max("nid").alias("last"), F.count(F.lit(1)).alias("size")).where("hub < last")
    shared = materialize(sizes.select("key", "hub", "size"), "buckets")
    # Keys of very many members go to the rows; the others' rows are dealt out by key.
    hot = shared.where(F.col("size") > SPLIT)
    sent = _sent(hot)
    few = bands.join(_sent(hot.select("key")), "key", "left_anti").join(shared.where(F.col("size") <= SPLIT), "key")
    members = materialize(few.unionByName(bands.join(sent, "key")), "members")
    discard(bands)
    candidates = materialize(nodes.join(members.select("nid").distinct(), "nid"), "candidates")
    wanted = candidates.select("nid", "set_id", F.col("doc_id").alias("w_doc_id"), F.col("text_hash").alias("w_text_hash"))
    sets = materialize(_sets(_rows_of(docs, candidates), wanted, width), "sets")

    small, large = members.where(F.col("size") <= SMALL_BUCKET), members.where(F.col("size") > SMALL_BUCKET)
    every = small.select("key", F.col("nid").alias("a")).join(small.select("key", F.col("nid").alias("b")), "key").where("a < b").select("a", "b")
    pairs = every.unionByName(large.where("nid <> hub").select(F.col("hub").alias("a"), F.col("nid").alias("b")))
    links = materialize(_verify(_estimate(pairs.distinct(), candidates, percent), sets, percent), "links")
    labels = components(links)
    # Large buckets that hold one component are done; the others are compared in whole blocks.
    open_ = large.select("key", "nid", "size").join(labels, "nid", "left").select("key", "nid", "size", F.coalesce("label", "nid").alias("label"))
    unsettled = open_.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    open_ = materialize(open_.join(_sent(materialize(unsettled, "unsettled")), "key").select("key", "nid", "size", "label"), "open")
    if not open_.isEmpty():
        blocks = F.ceil(F.col("size") / BLOCK).cast("int")
        rows = open_.withColumn("side", F.pmod(F.xxhash64("nid"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        rows = rows.select("key", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "nid", "label")
        # Blocks are small and their comparison is not: as many tasks as there may be, whatever the bytes.
        tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = lambda df: df.repartition(tasks, "key", "low", "high").sortWithinPartitions("key", "low", "high")
        rows = materialize(_may_link(dealt(rows.join(candidates.select("nid", "n_shingles", "registers"), "nid")), percent), "may-link")
        more = _block_links(dealt(rows.join(sets, "nid")), percent)
        links = materialize(links.unionByName(more).distinct(), "links")
        labels = components(links)

    for spent in (members, candidates, sets, open_, shared):
        discard(spent)
    return signed, nodes.select("nid", "set_id", "doc_id", "text_hash").join(labels, "nid", "left").select("set_id", "doc_id", "text_hash", F.coalesce("label", "nid").alias("label"))


def superseded(docs: DataFrame, percent: int = 85, width: int = 5) -> tuple[DataFrame, bool]:
    """(doc_id, text_hash) of the documents to drop so that one of each group stays, and whether equal rows repeat.

    The one of smallest id stays, rows without an id last, and of equal ids the
    text of smallest xxhash64.  Documents without shingles are in no group.
    """
    signed, named = _labelled(docs, percent, width)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    stays = named.groupBy("label").agg(F.min(rank).alias("stays"))
    signed = signed.where("set_id is not null")
    rows = signed.join(named.join(stays, "label").select("set_id", "stays"), "set_id")
    repeats = not signed.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    return rows.where(rank != F.col("stays")).select("doc_id", "text_hash").distinct(), repeats


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    signed, named = _labelled(docs, percent, width)
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    component = named.join(least, "label").select("set_id", "component_id")
    out = signed.select("doc_id", "n_shingles", "set_id").join(component, "set_id", "left")
    component_id = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component_id.alias("component_id"), F.coalesce(F.col("doc_id") == component_id, F.lit(False)).alias("kept"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


#: The same in DuckDB's SQL, by exact set similarity of all pairs: for small tables only.
ORACLE = """
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS k FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.k + ny.k - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.y FROM reach r JOIN edges e ON r.b = e.x),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.k, 0) AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN least l ON l.a = d.doc_id
"""
