"""The engine's entry points."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from veinstone.functions.user import user_function
from veinstone.sql import nodes as N
from veinstone.sql.compiler import compile_query
from veinstone.sql.parser import parse as _parse
from veinstone.sql.tokens import tokenize
from veinstone.sql.visitors import derived_alias, extract_tables


class Engine:
    """Tables and functions by name, and queries over them."""

    def __init__(self, spark: SparkSession, tables: dict[str, Any] | None = None, functions: dict[str, Any] | None = None):
        self.spark = spark
        self.tables: dict[str, DataFrame] = {}
        self.functions: dict = {}
        for name, t in (tables or {}).items():
            self.register(name, t)
        for name, f in (functions or {}).items():
            self.function(name, f)

    def register(self, name: str, table: DataFrame | list[dict], schema: str | T.StructType | None = None) -> "Engine":
        """A DataFrame, or rows as dicts of equal keys; an empty list needs a schema."""
        self.tables[name] = table if isinstance(table, DataFrame) else from_rows(self.spark, table, schema)
        return self

    def function(self, name: str, f, **kw) -> "Engine":
        self.functions[name.upper()] = user_function(f, **kw)
        return self

    def parse(self, query: str) -> N.Node:
        return _parse(query, self.functions)

    def sql(self, query: str | N.Node, tables: dict[str, Any] | None = None, functions: dict[str, Any] | None = None) -> DataFrame:
        """The query's result, not yet computed.

        Positional joins and row numbers over all rows need partitions that
        don't change: behind a shuffle their input is checkpointed here already.
        """
        also = {k.upper(): user_function(f) for k, f in (functions or {}).items()}
        every = self.functions | also
        extra = {k: t if isinstance(t, DataFrame) else from_rows(self.spark, t) for k, t in (tables or {}).items()}
        node = _parse(query, every) if isinstance(query, str) else query
        return compile_query(self.spark, node, self.tables | extra, every)

    def plan(self, query: str | N.Node) -> DataFrame:
        """The query's plan: names and types are resolved, and errors in them raised.  A DataFrame is a plan to Spark."""
        return self.sql(query)

    def execute(self, plan: DataFrame) -> list[dict]:
        """The rows of a plan."""
        return collect(plan)

    def explain(self, query: str) -> str:
        """Spark's plan of the query."""
        return self.sql(query)._jdf.queryExecution().toString()


def from_rows(spark: SparkSession, rows: list[dict], schema: str | T.StructType | None = None) -> DataFrame:
    """A table of dicts; the first row names the columns and the first 1,000 must agree with it."""
    if not rows and schema is None:
        raise ValueError("A table without rows needs a schema")
    if rows:
        keys = list(rows[0])
        for k, r in enumerate(rows[:1000]):
            if set(r) != set(keys):
                raise ValueError(f"Row {k} has other columns than row 0")
        if schema is None:
            return spark.createDataFrame([tuple(r.get(k) for k in keys) for r in rows], keys)
        return spark.createDataFrame([tuple(r.get(k) for k in keys) for r in rows], schema)
    return spark.createDataFrame([], schema)


def collect(df: DataFrame) -> list[dict]:
    """All rows as dicts, on the driver."""
    return [r.asDict(recursive=True) for r in df.collect()]


__all__ = ["Engine", "collect", "derived_alias", "extract_tables", "from_rows", "tokenize"]
