"""Structured Streaming forms of bounded queries: incremental delivery, windows and cancellation."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(df: DataFrame, time: str, width: str, aggregates: list[Column], keys: list[str] | None = None, late: str | None = None) -> DataFrame:
    """Aggregates per time window, and per key if given; works on bounded and streaming frames.

    late: how far a streaming frame's watermark trails its newest row.
    """
    df = df.withWatermark(time, late) if late and df.isStreaming else df
    out = df.groupBy(F.window(time, width), *(keys or [])).agg(*aggregates)
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *[c for c in out.columns if c != "window"])


def rows(df: DataFrame) -> Iterator[dict]:
    """Rows as they come, a partition at a time."""
    for r in df.toLocalIterator(prefetchPartitions=True):
        yield r.asDict(recursive=True)


class Cancellable:
    """Runs a query's jobs under a tag, so that another thread can stop them."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.tag = spark, tag

    def __enter__(self) -> "Cancellable":
        self.spark.sparkContext.addJobTag(self.tag)
        return self

    def __exit__(self, *_) -> None:
        self.spark.sparkContext.removeJobTag(self.tag)

    def cancel(self) -> None:
        self.spark.sparkContext.cancelJobsWithTag(self.tag)
