"""User functions: plain or async Python, run in Arrow batches."""

from __future__ import annotations

import asyncio
import inspect
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class UserFunction:
    """apply takes the arguments of one row; an async one is awaited for a whole batch at once."""

    apply: Callable
    low: int = 0
    high: int | None = None
    returns: str | T.DataType = "string"
    text: str = "..."

    def build(self, args: list[Column]) -> Column:
        apply, is_async, some = self.apply, inspect.iscoroutinefunction(self.apply), bool(args)

        @F.pandas_udf(self.returns)
        def run(*columns: pd.Series) -> pd.Series:
            rows = list(zip(*[[None if v is None or (isinstance(v, float) and v != v) else v for v in c] for c in columns])) if some else [()] * len(columns[0])
            if is_async:

                async def gather():
                    return await asyncio.gather(*[apply(*r) for r in rows])

                return pd.Series(asyncio.run(gather()), dtype=object)
            return pd.Series([apply(*r) for r in rows], dtype=object)

        return run(*args) if args else run(F.rand())  # a column of any kind says how many rows there are


def user_function(f, **kw) -> UserFunction:
    """A UserFunction from one, from a callable, or from a dict with apply, returns and arguments."""
    if isinstance(f, UserFunction):
        return f
    if isinstance(f, dict):
        bounds = f.get("arguments", {})
        return UserFunction(f["apply"], bounds.get("min", 0), bounds.get("max"), f.get("returns", "string"), bounds.get("signature", "..."))
    n = len(inspect.signature(f).parameters)
    return UserFunction(f, n, n, **kw)
