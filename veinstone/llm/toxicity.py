"""Toxicity by a factorization machine over hashed terms.

Terms are lower-cased words, their four- and five-letter beginnings and a mark
for shouted words, hashed into a fixed space; a document is the set of its
terms, each of value x = 1 / sqrt(1 + terms / TYPICAL).  score = sigmoid(w0 +
sum w_i x + sum over pairs <v_i, v_j> x^2): the second part learns interactions
that additive weights miss.  It is fitted with numpy on the driver on at most
MOST_ROWS labelled documents, with all their terms: none is dropped beforehand,
as one that is neutral alone may decide in a pair.  In the first epochs weights
and factors of terms that explain nothing shrink to zero; in the others, what
is left is fitted without that pull.  The model's size is the hash space's.

Null and empty texts have no term and get the score of the bias.  Every row is
scored on its own; repeated rows get equal scores.  Without labels of both
kinds the score is the smoothed share of label 1.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.llm.common import filter_texts, held_out, kept_in_tasks, map_frames, read_table
from veinstone.llm.labelled import training_rows

SPACE = 1 << 18
FACTORS = 4
MOST_ROWS = 6000
#: Terms of a document from which on their values shrink.
TYPICAL = 100.0
#: Steps a pass, passes over the documents, the first of these that select, and AdaGrad's rate and first sum of squares.
BATCHES, EPOCHS, SELECTING, RATE, HOLD = 48, 16, 8, 0.15, 1.0
#: Weight decay, the pull to zero while selecting (of a weight and of a term's factors together; chance sums of gradients grow
#: with the root of the documents, and so does the pull), and the factors' first size.
DECAY, PULL, START = 0.1, 0.08, 0.05
MEMO = 300_000
OUT = "doc_id long, held_out boolean, score double, predicted int"
_WORD = re.compile(r"[^\W_]+")
_memo: dict[str, tuple[int, ...]] = {}
kept_in_tasks("terms", _memo.clear)


def term_ids(word: str) -> tuple[int, ...]:
    low = word.lower()
    terms = [low]
    if len(low) > 5:
        terms += ["^4" + low[:4], "^5" + low[:5]]
    if len(word) > 2 and word.isupper():
        terms.append("^SHOUT")
    return tuple(zlib.crc32(t.encode("utf-8", "replace")) % SPACE for t in terms)


def document_terms(text: str | None) -> np.ndarray:
    """The distinct term ids of a whole text, ascending."""
    ids: set[int] = set()
    if len(_memo) > MEMO:
        _memo.clear()
    for w in set(_WORD.findall(text)) if isinstance(text, str) else ():
        t = _memo.get(w)
        if t is None:
            t = _memo[w] = term_ids(w)
        ids.update(t)
    out = np.fromiter(ids, np.int32, len(ids))
    out.sort()
    return out


class FactorizationMachine:
    """bias, a weight and FACTORS factors for every term of the hash space."""

    def __init__(self, bias: float, theta: np.ndarray):
        self.bias, self.theta = bias, theta

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(docs), self.bias)
        full = [i for i, d in enumerate(docs) if len(d)]
        if full:
            size = np.array([len(docs[i]) for i in full])
            z = _sums(self.theta, np.concatenate([docs[i] for i in full]), np.cumsum(size) - size, _values(size))[0]
            out[full] += z
        return 1.0 / (1.0 + np.exp(-np.clip(out, -40, 40)))


def _values(size: np.ndarray) -> np.ndarray:
    """The value of each term of a document, in the linear and in the pair part alike: less in long documents."""
    return (1.0 / np.sqrt(1.0 + size / TYPICAL)).astype(np.float32)


def _sums(theta: np.ndarray, ids: np.ndarray, start: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents whose ids begin at `start`: score without bias, sums of factors, and the rows of theta, as valued."""
    rows = theta[ids] * np.repeat(x, np.diff(np.append(start, len(ids))))[:, None]
    total = np.add.reduceat(rows, start, axis=0)
    squares = np.add.reduceat(np.einsum("ij,ij->i", rows[:, 1:], rows[:, 1:]), start)
    s = total[:, 1:]
    return total[:, 0] + 0.5 * (np.einsum("ij,ij->i", s, s) - squares), s, rows


def fit(docs: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, decay: float = DECAY, seed: int = 7) -> FactorizationMachine:
    """Logistic loss over all terms by AdaGrad in batches of BATCH documents.

    Penalties are of the whole sample's loss: a term's share of them at each step
    is one over its batches, so terms of few documents are held back.
    """
    n = len(docs)
    share = (float(y.sum()) + 1) / (n + 2)
    bias = float(np.log(share / (1 - share)))
    theta = np.zeros((SPACE, FACTORS + 1), np.float32)
    if not n or y.min() == y.max():
        return FactorizationMachine(bias, theta)
    rng = np.random.default_rng(seed)
    used = np.unique(np.concatenate(docs))
    theta[used, 1:] = rng.normal(0, START, (len(used), FACTORS))
    batches = []
    width = max(8, -(-n // BATCHES))
    order = rng.permutation([i for i in range(n) if len(docs[i])])
    for at in range(0, len(order), width):
        part = order[at : at + width]
        size = np.array([len(docs[i]) for i in part])
        ids, local = np.unique(np.concatenate([docs[i] for i in part]), return_inverse=True)
        batches.append((ids, local, size, np.cumsum(size) - size, _values(size), y[part]))
    touched = np.bincount(np.concatenate([b[0] for b in batches]), minlength=SPACE).astype(np.float32)  # batches of each term
    pull = PULL * np.sqrt(n)
    squares, bias_squares = np.full(theta.shape, HOLD, np.float32), HOLD
    for epoch in range(epochs):
        selecting = epoch < SELECTING
        live = theta != 0
        for k in rng.permutation(len(batches)):
            ids, local, size, start, x, target = batches[k]
            mine = theta[ids]
            z, s, rows = _sums(mine, local, start, x)
            g = (1 / (1 + np.exp(-np.clip(z + bias, -40, 40))) - target).astype(np.float32)
            each = np.repeat(g * x, size)
            grad = np.empty_like(mine)
            grad[:, 0] = np.bincount(local, each, len(ids))
            for f in range(FACTORS):
                grad[:, f + 1] = np.bincount(local, each * (np.repeat(s[:, f], size) - rows[:, f + 1]), len(ids))
            grad += (decay / touched[ids])[:, None] * mine
            squares[ids] += grad * grad
            pace = rate / np.sqrt(squares[ids])
            mine -= pace * grad
            if selecting:
                less = (pull / touched[ids]).astype(np.float32)
                mine[:, 0] = np.sign(mine[:, 0]) * np.maximum(0, np.abs(mine[:, 0]) - pace[:, 0] * less)
                length = np.sqrt(np.einsum("ij,ij->i", mine[:, 1:], mine[:, 1:]))
                mine[:, 1:] *= np.maximum(0, 1 - pace[:, 1:].mean(1) * less / np.maximum(length, 1e-9))[:, None]
            else:
                mine *= live[ids]
            theta[ids] = mine
            bias_squares += float(g.sum()) ** 2
            bias -= rate * float(g.sum()) / np.sqrt(bias_squares)
    return FactorizationMachine(bias, theta)


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> FactorizationMachine:
    """Terms are extracted on the executors; the driver gets ids of at most `most` documents."""

    def run(batches):
        for b in batches:
            yield b.drop(columns="text").assign(terms=[document_terms(t).tobytes() for t in b["text"]])

    terms = map_frames(training_rows(docs, labels, "toxic", most).select("doc_id", "y", "text"), run, "doc_id long, y int, terms binary")
    rows = terms.orderBy(F.xxhash64("doc_id"), "doc_id", "y", "terms").limit(most).collect()
    return fit([np.frombuffer(r["terms"], np.int32) for r in rows], np.array([r["y"] for r in rows], float))


def score(docs: DataFrame, model: FactorizationMachine, threshold: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= threshold) of every document."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # at most SPACE * (FACTORS + 2) numbers

    def run(batches):
        for b in batches:
            p = shared.value.scores([document_terms(t) for t in b["text"]])
            yield b.drop(columns="text").assign(score=p, predicted=(p >= threshold).astype("int32"))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_frames(rows, run, OUT)


def keep_clean(docs: DataFrame, model: FactorizationMachine, threshold: float = 0.5) -> DataFrame:
    """The documents that score under the threshold, with their own columns."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    return filter_texts(docs, lambda texts: shared.value.scores([document_terms(t) for t in texts]) < threshold)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score(docs, train(docs, read_table(spark, sf_dir, "labels")))
