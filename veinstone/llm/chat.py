"""Chat formatting by quotation linking.

Lines that begin with `>` marks are quotes, their level the number of marks;
neighbouring lines of one level make a passage.  Quoted passages and a message's
unquoted text give the same units: the whole, its paragraphs, lines and
sentences, normalised (lower case, letters and digits only) and hashed.  A unit
joins to the earliest message that holds it, first in the same conversation,
then anywhere earlier.  Parts of a quote, and any unit across conversations,
must tell something: they have LEAST_WORDS words or more, or no other
conversation than the original's holds them.  The lowest level that joins, and in it a whole quote before
its parts, names the message replied to; without one it is the turn before.
Parts of a sentence join nothing.  Messages have no time, so earlier means a
smaller conv_id: an original in a later-numbered conversation is not linked, for
a reply must come after its original and links must make no circle.

Originals are reduced to one row per passage before the join, so passages that
many messages share make no pairs, and quotes of such a passage and messages
of a huge conversation are dealt out in parts.  Conversations linked by quotes
form one thread; position numbers a thread's messages from 0, each reply after
its original.  conversations() writes threads out in parts of CHUNK messages.
Null texts count as empty; messages of equal (conv_id, turn) are linked alike
and follow one another; a null conv_id or turn links to nothing, and messages
without conv_id form one thread of their own.
"""

from __future__ import annotations

import re

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veinstone.llm.common import join_dealt, map_frames, materialize, read_table
from veinstone.llm.near_dedup import components
from veinstone.operators.ordinal import with_ordinal

LEAST_WORDS = 4
CHUNK = 10_000
_MARKS = re.compile(r"(?:[ \t]{0,3}>)+ ?")
_PLAIN = re.compile(r"[\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def passage_hash(text: str) -> tuple[int, int] | None:
    """(hash, words) of a normalised passage; None if it has no word."""
    words = _PLAIN.sub(" ", text.lower()).split()
    return (xxhash.xxh3_64_intdigest(" ".join(words).encode("utf-8", "replace")) - (1 << 63), len(words)) if words else None


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """The text without quotes, and the quoted passages with their levels."""
    if not isinstance(text, str):
        return "", []
    if ">" not in text:
        return text.strip(), []
    own, quoted = [], []
    for line in text.split("\n"):
        m = _MARKS.match(line)
        level = m[0].count(">") if m else 0
        body = line[m.end() :] if m else line
        if not level:
            own.append(body)
        elif quoted and quoted[-1][0] == level and quoted[-1][2] == len(own):
            quoted[-1][1].append(body)
        else:
            quoted.append([level, [body], len(own)])
    return "\n".join(own).strip(), [(level, "\n".join(lines)) for level, lines, _ in quoted]


def units(text: str) -> list[tuple[int, int, bool]]:
    """(hash, words, whether a part) of the whole text first, then of its paragraphs, lines and sentences, each hash once."""
    paragraphs = re.split(r"\n[ \t]*\n", text)
    parts = [*paragraphs, *text.split("\n"), *(s for p in paragraphs for s in _SENTENCE.split(p))]
    out: dict[int, tuple[int, int, bool]] = {}
    for k, p in enumerate([text, *parts]):
        if h := passage_hash(p):
            out.setdefault(h[0], (*h, k > 0))
    return list(out.values())


def own_passages(text: str) -> set[int]:
    """Hashes of the whole text and of its paragraphs, lines and sentences."""
    return {h for h, _, _ in units(text)}


def _parsed(messages: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            rows = []
            for text in b["text"]:
                own, quoted = parse(text)
                hashes = [(k, level, *u) for k, (level, q) in enumerate(quoted) for u in units(q)]
                rows.append((own, sorted(own_passages(own)), [{"quote": k, "level": x, "hash": h, "words": w, "part": p} for k, x, h, w, p in hashes], len(quoted)))
            yield pd.concat([b.drop(columns="text").reset_index(drop=True), pd.DataFrame(rows, columns=["own", "passages", "quotes", "n_quoted"])], axis=1)

    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return map_frames(rows, run, "conv_id long, turn long, role string, own string, passages array<long>, quotes array<struct<quote:int,level:int,hash:long,words:int,part:boolean>>, n_quoted long")


def _previous(places: DataFrame) -> DataFrame:
    """(conv_id, turn, previous) of distinct places; windows hold CHUNK turns, so a huge conversation is split."""
    chunked = places.withColumn("chunk", F.floor(F.col("turn") / CHUNK))
    inside = Window.partitionBy("conv_id", "chunk").orderBy("turn")
    across = Window.partitionBy("conv_id").orderBy("chunk")
    last = chunked.groupBy("conv_id", "chunk").agg(F.max("turn").alias("top")).withColumn("before", F.lag("top").over(across)).select("conv_id", "chunk", "before")
    return chunked.withColumn("lagged", F.lag("turn").over(inside)).join(last, ["conv_id", "chunk"]).select("conv_id", "turn", F.coalesce("lagged", "before").alias("previous"))


def link(messages: DataFrame) -> DataFrame:
    """A row per message: conv_id, turn, role, thread_id, reply_conv, reply_turn, linked_by, n_quoted, n_linked, text and chat."""
    parsed = materialize(_parsed(messages).withColumn("mid", F.monotonically_increasing_id()), "messages")
    placed = parsed.where("conv_id is not null and turn is not null")
    quotes = placed.where(F.size("quotes") > 0).select("mid", "conv_id", "turn", F.explode("quotes").alias("q")).select("mid", "conv_id", "turn", "q.quote", "q.level", "q.hash", "q.words", "q.part")
    wanted = quotes.select("hash").distinct()
    own = placed.select("conv_id", "turn", F.explode("passages").alias("hash")).join(wanted, "hash", "left_semi")
    in_conv = materialize(own.groupBy("conv_id", "hash").agg(F.min("turn").alias("in_turn")), "passages")
    anywhere = in_conv.groupBy("hash").agg(F.min(F.struct("conv_id", F.col("in_turn").alias("turn"))).alias("first"), F.count(F.lit(1)).alias("holders"))
    found = join_dealt(join_dealt(quotes, in_conv, ["conv_id", "hash"]), anywhere, ["hash"])
    here = F.col("in_turn") < F.col("turn")
    # The quoting conversation itself may hold the unit too, later on.
    others = F.col("holders") - F.when(F.col("in_turn").isNotNull(), 1).otherwise(0)
    inside = here & (~F.col("part") | (F.col("words") >= LEAST_WORDS) | (others == 0))
    earlier = ((F.col("words") >= LEAST_WORDS) | (others == 1)) & (F.col("first") < F.struct("conv_id", "turn"))
    found = found.withColumn("target", F.when(inside, F.struct("conv_id", F.col("in_turn").alias("turn"))).when(earlier & (F.col("first.conv_id") != F.col("conv_id")), F.col("first")))
    best = found.where("target is not null").groupBy("mid").agg(F.min(F.struct("level", "part", F.when(inside, 0).otherwise(1).alias("far"), "target")).alias("b"), F.count_distinct("quote").alias("n_linked"))
    best = materialize(best.select("mid", F.col("b.target.conv_id").alias("q_conv"), F.col("b.target.turn").alias("q_turn"), "n_linked"), "quote-links")

    rows = parsed.drop("passages", "quotes").join(best, "mid", "left").join(_previous(placed.select("conv_id", "turn").distinct()), ["conv_id", "turn"], "left")
    between = placed.join(best, "mid").where("q_conv <> conv_id").select(F.col("q_conv").alias("a"), F.col("conv_id").alias("b")).distinct()
    threads = components(between).select(F.col("nid").alias("conv_id"), F.col("label").alias("thread"))
    rows = join_dealt(rows, threads, ["conv_id"])
    by = F.when(F.col("q_turn").isNotNull(), "quote").when(F.col("previous").isNotNull(), "previous").otherwise("none")
    out = rows.select(
        "mid", "conv_id", "turn", "role", F.coalesce("thread", "conv_id").alias("thread_id"),
        F.coalesce("q_conv", F.when(F.col("previous").isNotNull(), F.col("conv_id"))).alias("reply_conv"), F.coalesce("q_turn", "previous").alias("reply_turn"),
        by.alias("linked_by"), "n_quoted", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.col("own").alias("text"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), "own", F.lit("\n<|end|>")).alias("chat"),
    )
    # Sorted by ranges and numbered by counts per range, then from each thread's first row.
    placed = with_ordinal(out.orderBy("thread_id", F.col("conv_id").asc_nulls_last(), F.col("turn").asc_nulls_last(), "mid"), "place")
    placed = materialize(placed, "chat")
    first = placed.groupBy("thread_id").agg(F.min("place").alias("first"))
    unknown = placed.where("thread_id is null").agg(F.min("place").alias("p")).first()["p"]  # one number
    base = F.coalesce("first", F.lit(unknown).cast("long"))
    return join_dealt(placed, first.where("thread_id is not null"), ["thread_id"]).withColumn("position", F.col("place") - base).drop("place", "first", "mid")


def conversations(linked: DataFrame, most: int = CHUNK) -> DataFrame:
    """thread_id, part, n_messages and chat: threads in reply order without quotes, `most` messages in a part."""
    part = F.floor(F.col("position") / most).alias("part")
    rows = linked.groupBy("thread_id", part).agg(F.count(F.lit(1)).alias("n_messages"), F.sort_array(F.collect_list(F.struct("position", "chat"))).alias("rows"))
    return rows.select("thread_id", "part", "n_messages", F.array_join(F.transform("rows", lambda x: x["chat"]), "\n").alias("chat"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(read_table(spark, sf_dir, "conversations"))
