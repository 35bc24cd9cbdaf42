"""Tables from files, and a pluggable scan."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual


def parquet_tables(spark: SparkSession, folder: str, names: Iterable[str]) -> dict[str, DataFrame]:
    """The named Parquet tables of a folder; Spark prunes columns and pushes filters by itself."""
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def cached(df: DataFrame) -> DataFrame:
    """df, kept after its first use."""
    return df.persist()


def custom_source(name: str, schema: str, scan: Callable[[dict], Iterable[tuple]], parts: int = 1, pushdown: bool = False) -> type[DataSource]:
    """A data source over a Python scan.

    scan gets {"part": i, "parts": n, "filters": [(op, column, value), ...]}
    and yields rows.  pushdown needs spark.sql.python.filterPushdown.enabled;
    the filters are then hints that save work: Spark applies
    every filter again to what the scan yields.  Register the class with
    spark.dataSource.register and read it by its name.
    """

    class Reader(DataSourceReader):
        def __init__(self):
            self.filters: list[tuple] = []

        def partitions(self):
            return [InputPartition(i) for i in range(parts)]

        def read(self, partition):
            yield from scan({"part": partition.value, "parts": parts, "filters": self.filters})

    class FilteringReader(Reader):
        def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
            ops = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
            for f in filters:
                if type(f) in ops and len(f.attribute) == 1:
                    self.filters.append((ops[type(f)], f.attribute[0], f.value))
                yield f

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema):
            return FilteringReader() if pushdown else Reader()

    return Source


def to_batches(df: DataFrame, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The result as Arrow batches of at most `rows` rows, a partition at a time on the driver."""
    names = df.columns
    held: list[tuple] = []
    schema = df.limit(0).toArrow().schema
    for r in df.toLocalIterator(prefetchPartitions=True):
        held.append(tuple(r))
        if len(held) == rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], names)


def from_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of Arrow batches, in order."""
    for b in batches:
        yield from b.to_pylist()
