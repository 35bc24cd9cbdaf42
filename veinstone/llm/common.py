"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Only where a local session has none (tests, a laptop) is one made here: on
    a cluster a folder of one machine would lose rows, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        hadoop_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = hadoop_dir.get() if hadoop_dir.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = os.path.join(tempfile.gettempdir(), "veinstone-checkpoint")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    It cuts the lineage, survives lost executors, and freezes values that a
    recomputation might number differently.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veinstone-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._veinstone_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a materialized table that nothing reads any more."""
    path = getattr(df, "_veinstone_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


#: Up to so many rows of ids or keys are broadcast; beyond, a shuffled join does the same.
MOST_SENT = 100_000


def join_dealt(rows: DataFrame, values: DataFrame, keys: list[str], split: int = 1024) -> DataFrame:
    """rows left joined with values, which hold a key once at most.

    The rows of a key that has more than `split` are dealt out in parts, with
    the key's values copied to each part, so no key is one task's.
    """
    parts = F.ceil(F.col("n") / split).cast("int")
    hot = materialize(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > split).select(*keys, parts.alias("parts")), "hot-keys")
    if hot.isEmpty():
        return rows.join(values, keys, "left")
    sent = F.broadcast(hot) if hot.count() <= MOST_SENT else hot
    rest = [f.name for f in rows.schema.fields if f.name not in keys and not isinstance(f.dataType, T.MapType)]
    # By the row's own values, so that a task that runs again deals it out alike.
    dealt = rows.join(sent, keys, "left").withColumn("part", F.pmod(F.xxhash64(*rest), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    copied = values.join(sent, keys, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.join(copied, [*keys, "part"], "left").drop("part")


def slices(batch: pa.RecordBatch, rows: int = 512, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most `rows` rows and, unless one row alone is larger, `size` bytes: texts can be long."""
    if batch.num_rows > 1 and (batch.num_rows > rows or batch.nbytes > size):
        half = batch.num_rows // 2
        yield from slices(batch.slice(0, half), rows, size)
        yield from slices(batch.slice(half), rows, size)
    else:
        yield batch


def held_out(doc_id: Column) -> Column:
    """True for the evaluation fold: crc32 of the id as text, modulo five."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


_caches: dict[str, Callable[[], object]] = {}


def kept_in_tasks(name: str, clear: Callable[[], object]) -> None:
    """Name a module's cache that tidied() empties."""
    _caches[name] = clear


def _free_caches(keep: str | None) -> None:
    for name, clear in _caches.items():
        if name != keep:
            clear()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's only
    if trim:
        trim(0)


def tidied(rows: Iterator, keep: str | None = None) -> Iterator:
    """rows; before the first and behind the last of them, caches but `keep` are emptied and freed memory goes back to the system.

    Python workers live on from task to task and stage to stage: what one
    operator leaves in them would count against the next one's memory.
    """
    _free_caches(keep)
    try:
        yield from rows
    finally:
        _free_caches(keep)


_NULLABLE = {pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}


def map_frames(df: DataFrame, run: Callable, ddl: str, rows: int = 512) -> DataFrame:
    """mapInPandas on small parts, in which integer columns with nulls stay integers, so that ids keep all their digits."""
    schema = T._parse_datatype_string(ddl)
    arrow = to_arrow_schema(schema)

    def go(batches):
        for out in run(part.to_pandas(types_mapper=_NULLABLE.get) for b in batches for part in slices(b, rows)):
            yield pa.RecordBatch.from_pandas(out[arrow.names], schema=arrow, preserve_index=False)

    return df.mapInArrow(lambda batches: tidied(go(batches)), schema)


def filter_texts(df: DataFrame, keep: Callable[[list], list]) -> DataFrame:
    """The rows for whose texts keep() says true; all columns pass through untouched."""

    def go(batches):
        for b in batches:
            for part in slices(b):
                yield part.filter(pa.array(keep(part.column("text").to_pylist()), pa.bool_()))

    return df.mapInArrow(lambda batches: tidied(go(batches)), df.schema)
