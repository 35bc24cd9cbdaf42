"""Quality by random-indexing word vectors and a small calibrated network.

1. Tokens (words, numbers, punctuation runs; shouted words are marked) are
   hashed into BUCKETS.  Every bucket has a fixed sparse ternary index vector;
   a bucket's context vector is the sum of the index vectors of the tokens
   within WINDOW places, over all documents.  Tasks add theirs up in numpy and
   Spark sums the parts per bucket: BUCKETS rows of DIM numbers come to the
   driver, whatever the input.
2. A document's vector is the mean of its tokens' normalised context vectors,
   their mean absolute deviation, and a few shares of token shapes.
3. A two-layer network is fitted with numpy on at most MOST_ROWS labelled
   documents, and its temperature on a part of them that it didn't see.

Null and empty texts have the zero vector and get the network's score for it.
Every row is scored on its own; repeated rows get equal scores.  Without
labels of both kinds the score is the smoothed share of label 1.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.llm.common import held_out, map_frames, read_table
from veinstone.llm.labelled import training_rows

BUCKETS = 1 << 15
DIM = 48
NONZERO = 2
WINDOW = 2
MOST_ROWS = 6000
HIDDEN = 24
MEMO = 400_000
SHAPES = 5  # word, shouted word, number, punctuation run, and the share of repeated tokens
OUT = "doc_id long, held_out boolean, score double, predicted int"
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
_memo: dict[str, int] = {}


def token_code(token: str) -> int:
    """Bucket times four plus shape."""
    c = token[0]
    shape = 2 if c.isdigit() else 3 if not c.isalpha() else 1 if len(token) > 1 and token.isupper() else 0
    name = "#" if shape == 2 else token[:3] if shape == 3 else ("^" if shape == 1 else "") + token.lower()
    return zlib.crc32(name.encode("utf-8", "replace")) % BUCKETS * 4 + shape


def codes(text: str | None) -> np.ndarray:
    if not isinstance(text, str) or not text:
        return np.zeros(0, np.int64)
    tokens = _TOKEN.findall(text)
    try:
        return np.fromiter(map(_memo.__getitem__, tokens), np.int64, len(tokens))
    except KeyError:
        if len(_memo) > MEMO:
            _memo.clear()
        for t in set(tokens):
            if t not in _memo:
                _memo[t] = token_code(t)
        return np.fromiter(map(_memo.__getitem__, tokens), np.int64, len(tokens))


def index_vectors(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of every bucket's NONZERO entries; the last bucket, a gap, has none."""
    rng = np.random.default_rng(seed)
    place = np.concatenate([np.argsort(rng.random((BUCKETS, DIM)), axis=1)[:, :NONZERO], np.zeros((1, NONZERO), np.int64)])
    sign = np.concatenate([rng.choice([-1.0, 1.0], (BUCKETS, NONZERO)), np.zeros((1, NONZERO))])
    return place, sign


def context_sums(docs: list[np.ndarray]) -> np.ndarray:
    """BUCKETS x DIM sums of the neighbours' index vectors."""
    place, sign = index_vectors()
    gap = np.full(WINDOW, BUCKETS)
    ids = np.concatenate([x for d in docs for x in (d >> 2, gap)]) if docs else gap
    out = np.zeros((BUCKETS + 1) * DIM)
    for k in range(1, WINDOW + 1):
        for a, b in ((ids[:-k], ids[k:]), (ids[k:], ids[:-k])):
            for s in range(NONZERO):
                out += np.bincount(a * DIM + place[b, s], sign[b, s], len(out))
    return out.reshape(BUCKETS + 1, DIM)[:BUCKETS]


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Context vectors of all buckets over all documents, each of length 1 (or 0)."""
    columns = [f"v{i}" for i in range(DIM)]

    def run(batches):
        total = np.zeros((BUCKETS, DIM))
        for b in batches:
            total += context_sums([codes(t) for t in b["text"]])
        used = np.flatnonzero(total.any(axis=1))
        yield pd.DataFrame(total[used], columns=columns).assign(bucket=used)[["bucket", *columns]]

    parts = map_frames(docs.select("text"), run, "bucket int, " + ", ".join(f"{c} double" for c in columns))
    rows = parts.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in columns]).collect()  # BUCKETS rows at most
    out = np.zeros((BUCKETS, DIM))
    for r in rows:
        out[r["bucket"]] = r[1:]
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def pool(vectors: np.ndarray, d: np.ndarray) -> np.ndarray:
    """A document's features: 2 * DIM pooled entries, SHAPES shares and the log of its length."""
    if not len(d):
        return np.zeros(2 * DIM + SHAPES + 1, np.float32)
    distinct, times = np.unique(d, return_counts=True)
    v = vectors[distinct >> 2]
    weight = (times / len(d)).astype(np.float32)
    mean = weight @ v
    shape = np.bincount(distinct & 3, times, 4) / len(d)
    return np.concatenate([mean, weight @ np.abs(v - mean), shape, [1 - len(distinct) / len(d), np.log1p(len(d)) / 10]]).astype(np.float32)


class Network:
    def __init__(self, centre, scale, layers, temperature: float, constant: float | None = None):
        self.centre, self.scale, self.layers, self.temperature, self.constant = centre, scale, layers, temperature, constant

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.centre) / self.scale @ w1 + b1) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 0.02, decay: float = 1e-3, seed: int = 5) -> Network:
    """Adam on all but every fifth row; the temperature minimises those rows' log loss."""
    if not len(y) or y.min() == y.max():
        return Network(None, None, None, 1.0, (float(y.sum()) + 1) / (len(y) + 2))
    rng = np.random.default_rng(seed)
    calib = np.arange(len(y)) % 5 == 4
    if len(set(y[calib])) < 2 or len(set(y[~calib])) < 2:
        calib[:] = False
    xt, yt = x[~calib].astype(np.float64), y[~calib]
    net = Network(xt.mean(0), xt.std(0) + 1e-3, [rng.normal(0, 0.2, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.2, HIDDEN), 0.0], 1.0)
    z = (xt - net.centre) / net.scale
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in net.layers]
    for step in range(1, steps + 1):
        w1, b1, w2, b2 = net.layers
        h = np.tanh(z @ w1 + b1)
        g = (1 / (1 + np.exp(-np.clip(h @ w2 + b2, -40, 40))) - yt) / len(yt)
        back = np.outer(g, w2) * (1 - h * h)
        for i, grad in enumerate((z.T @ back + decay * w1, back.sum(0), h.T @ g + decay * w2, g.sum())):
            m, v = state[i]
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            state[i] = [m, v]
            net.layers[i] = net.layers[i] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    if calib.any():
        logit, target = net.logits(x[calib].astype(np.float64)), y[calib]
        loss = lambda t: np.mean(np.logaddexp(0, -np.where(target > 0, 1, -1) * logit / t))
        net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, most: int = MOST_ROWS) -> Network:
    """Documents are pooled on the executors; the driver gets at most `most` vectors."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)  # BUCKETS x DIM numbers

    def run(batches):
        for b in batches:
            yield b.drop(columns="text").assign(x=[pool(shared.value, codes(t)).tobytes() for t in b["text"]])

    pooled = map_frames(training_rows(docs, labels, "quality", most).select("doc_id", "y", "text"), run, "doc_id long, y int, x binary")
    rows = pooled.orderBy(F.xxhash64("doc_id"), "doc_id", "y", "x").limit(most).collect()
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows]) if rows else np.zeros((0, 2 * DIM + SHAPES + 1))
    return fit(x, np.array([r["y"] for r in rows], float))


def score(docs: DataFrame, vectors: np.ndarray, net: Network, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= threshold) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast((vectors, net))

    def run(batches):
        v, model = shared.value
        for b in batches:
            p = model.scores(np.array([pool(v, codes(t)) for t in b["text"]]).reshape(len(b), -1))
            yield b.drop(columns="text").assign(score=p, predicted=(p >= threshold).astype("int32"))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_frames(rows, run, OUT)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    vectors = word_vectors(docs)
    return score(docs, vectors, train(docs, read_table(spark, sf_dir, "labels"), vectors))
