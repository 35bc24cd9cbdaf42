"""Token counts by overlap resynchronisation.

A huge document is encoded in overlapping chunks.  Two neighbours are spliced
in their overlap at a place that is proven stable: no merge can cross it,
whatever stands around it (see tokenizing.PieceEncoder).  The overlap is encoded
with character offsets, which align the splice with a token's end and say how
many of its tokens each neighbour keeps.  Where the overlap holds no such
place, it is widened to twice its width; where the whole chunk holds none, as
in a run of one letter, the chunk grows to twice its length.  Places are looked
for in the text before anything is encoded, so a text is encoded about once
and time grows with its length.  Counts are exact.

Texts up to the chunk size are one chunk.  Null and empty texts have 0 bytes
and 0 tokens.  Rows are independent, so ties, repeated rows and hot keys need
no shuffle at all.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.llm.common import map_frames, read_table
from veinstone.llm.tokenizing import PieceEncoder, piece_encoder

CHUNK = 16_384
OVERLAP = 256
OUT = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def count_by_chunks(encoder: PieceEncoder, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of text, equal to encoder.count(text)."""
    total, start, spliced, skip = 0, 0, 0, 0  # skip: of the chunk's first tokens, those that its predecessor has counted
    while start + chunk < len(text):
        stop = start + chunk
        at = encoder.last_stable(text, max(spliced, start + 1), stop)
        while at < 0 and stop < len(text):  # no place in the whole chunk: only a longer one can help
            searched, stop = stop, min(len(text), 2 * stop - start)
            at = encoder.last_stable(text, searched - 1, stop)
        if at < 0:
            break
        width = overlap
        while stop - width >= at:
            width *= 2
        first = max(start + 1, stop - width)
        ends = encoder.boundaries(text[first:stop])
        kept = int(np.count_nonzero(ends <= at - first))
        total += encoder.count(text[start:stop]) - skip - (len(ends) - kept)
        start, spliced, skip = first, at, kept
    return total + encoder.count(text[start:]) - skip


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every document."""

    def run(batches):
        encoder = piece_encoder(path)
        for b in batches:
            texts = [t if isinstance(t, str) else "" for t in b["text"]]
            small = [t if len(t) <= chunk else "" for t in texts]
            n = encoder.counts(small)
            n = [count_by_chunks(encoder, t, chunk, overlap) if len(t) > chunk else k for t, k in zip(texts, n)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [k > limit for k in n]})

    return map_frames(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, OUT)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
