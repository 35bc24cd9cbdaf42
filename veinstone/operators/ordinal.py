"""Row positions, for operators whose result depends on input order."""

from __future__ import annotations

import os
import tempfile

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _frozen(df: DataFrame) -> DataFrame:
    """df with partitions that are the same however often they are read.

    A scan's are.  Behind a shuffle, adaptive execution may cut them anew for
    each use, so such a frame is checkpointed at once, in the folder that
    spark.checkpoint.dir names (one of our own only where a local session has
    none: on a cluster a folder of one machine would lose rows).
    """
    try:
        plan = df._jdf.queryExecution().executedPlan().toString()
    except AnalysisException:  # names of an outer query: only Spark can place it
        return df
    if "Exchange" not in plan:
        return df
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(found or os.path.join(tempfile.gettempdir(), "veinstone-checkpoint"))
    return df.checkpoint()


def with_ordinal(df: DataFrame, name: str) -> DataFrame:
    """df with its rows numbered from 0 in input order.

    Rows are counted per partition (one row per partition is shuffled), and
    each partition's rows start at the sum of the counts before it: two passes
    over the data, no single-task window over all of it.
    """
    marked = _frozen(df).withColumn(name + "_id", F.monotonically_increasing_id())
    part = F.shiftright(F.col(name + "_id"), 33).cast("int")
    counts = marked.groupBy(part.alias(name + "_p")).agg(F.count(F.lit(1)).alias(name + "_n"))
    before = Window.orderBy(name + "_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(name + "_p", F.coalesce(F.sum(name + "_n").over(before), F.lit(0)).alias(name + "_s"))
    joined = marked.withColumn(name + "_p", part).join(starts, name + "_p")
    place = F.col(name + "_s") + F.col(name + "_id").bitwiseAND(F.lit((1 << 33) - 1))
    return joined.withColumn(name, place).drop(name + "_id", name + "_p", name + "_s")


def positional_join(left: DataFrame, right: DataFrame, name: str = "__position") -> DataFrame:
    """Rows side by side by position; the shorter side is padded with nulls. Column names must differ."""
    a = with_ordinal(left, name)
    b = with_ordinal(right, name + "_r")
    return a.join(b, F.col(name) == F.col(name + "_r"), "full").drop(name, name + "_r")


def exact_percentile(df: DataFrame, value: str, fraction: float) -> DataFrame:
    """One row with the interpolated percentile of a column's non-null values; null if there are none.

    Equal values become one row with a count, sorted by ranges.  Sums per range
    say which one holds the wanted ranks, and only that one is looked into.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    counted = _frozen(counted.orderBy("v")).withColumn("p", F.spark_partition_id())
    sums = counted.groupBy("p").agg(F.sum("n").alias("m"))
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = ((F.sum("m").over(everything) - 1) * F.lit(float(fraction))).alias("at")
    starts = sums.select("p", "m", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("s"), place)  # a row per range
    low, high = F.floor("at"), F.ceil("at")
    near = counted.join(starts, "p").where((F.col("s") <= high) & (F.col("s") + F.col("m") > low))
    end = F.col("s") + F.sum("n").over(Window.partitionBy("p").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    near = near.select("v", "at", (end - F.col("n")).alias("a"), end.alias("b"))
    holds = lambda rank: (F.col("a") <= rank) & (rank < F.col("b"))
    found = near.agg(F.max(F.when(holds(low), F.col("v"))).alias("x"), F.max(F.when(holds(high), F.col("v"))).alias("y"), F.max("at").alias("at"))
    return found.select(F.when(low == high, F.col("x")).otherwise((high - F.col("at")) * F.col("x") + (F.col("at") - low) * F.col("y")).alias("v"))
