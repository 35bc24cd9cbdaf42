"""Aggregate functions: each builder gives one aggregate column."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veinstone.functions.types import Val, as_bool, as_double, as_text
from veinstone.sql.errors import ArgumentError


@dataclass(frozen=True)
class Aggregate:
    low: int
    high: int
    text: str
    build: Callable


REGISTRY: dict[str, Aggregate] = {}


def aggregate(*names: str, low: int = 1, high: int | None = None, text: str = "expression"):
    def put(f):
        for n in names:
            REGISTRY[n] = Aggregate(low, high or low, text, f)
        return f

    return put


def _kept(c: Column, where: Column | None) -> Column:
    """c on the rows that pass the filter, null elsewhere."""
    return c if where is None else F.when(where, c)


def numeric(v: Val) -> Column:
    """Text that isn't a number, NaN and infinities count as missing; integers stay exact."""
    if v.is_integer or isinstance(v.type, T.DecimalType):
        return v.col
    x = as_double(v)
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def _pairs(v: Val) -> Column:
    """A struct that is never null, so that collect_list keeps null values."""
    return F.struct(v.col.alias("v"))


@aggregate("COUNT")
def count(args, where, distinct, order):
    if args[0] is None:
        return F.count(F.lit(1)) if where is None else F.count_if(where)
    c = _kept(args[0].col, where)
    return F.count_distinct(c) if distinct else F.count(c)


@aggregate("COUNTIF", text="condition")
def countif(args, where, distinct, order):
    return F.count_if(as_bool(args[0]) if where is None else where & as_bool(args[0]))


@aggregate("SUM")
def total(args, where, distinct, order):
    c = _kept(numeric(args[0]), where)
    return F.sum_distinct(c) if distinct else F.sum(c)


@aggregate("AVG")
def average(args, where, distinct, order):
    c = _kept(numeric(args[0]), where)
    return F.expr("1") * F.sum_distinct(c) / F.count_distinct(c) if distinct else F.avg(c)


@aggregate("MIN")
def least(args, where, distinct, order):
    return F.min(_kept(args[0].col, where))


@aggregate("MAX")
def greatest(args, where, distinct, order):
    return F.max(_kept(args[0].col, where))


def _by(args, where, order, smallest: bool) -> Column:
    value, key = args
    ok = value.col.isNotNull() & key.col.isNotNull()
    ok = ok if where is None else ok & where
    if order is None:
        ranked = F.when(ok, key.col)
    else:
        ranked = F.when(ok, F.struct(key.col.alias("k"), (order if smallest else -order).alias("o")))
    return (F.min_by if smallest else F.max_by)(value.col, ranked)


@aggregate("MIN_BY", "ARG_MIN", low=2, text="value, key")
def min_by(args, where, distinct, order):
    return _by(args, where, order, True)


@aggregate("MAX_BY", "ARG_MAX", low=2, text="value, key")
def max_by(args, where, distinct, order):
    return _by(args, where, order, False)


@aggregate("ANY_VALUE")
def any_value(args, where, distinct, order):
    return F.first(_kept(args[0].col, where), ignorenulls=True)


@aggregate("STDDEV_SAMP")
def stddev_samp(args, where, distinct, order):
    return F.stddev_samp(_kept(numeric(args[0]), where))


@aggregate("STDDEV_POP")
def stddev_pop(args, where, distinct, order):
    return F.stddev_pop(_kept(numeric(args[0]), where))


def _percentile(v: Val, fraction: Val, where) -> Column:
    f = fraction.literal[0] if fraction.literal else None
    if not isinstance(f, (int, float)) or isinstance(f, bool) or not 0 <= f <= 1:
        raise ArgumentError("The fraction must be a number from 0 to 1")
    return F.percentile(_kept(numeric(v), where), F.lit(float(f)))


@aggregate("MEDIAN")
def median(args, where, distinct, order):
    return F.percentile(_kept(numeric(args[0]), where), F.lit(0.5))


@aggregate("PERCENTILE_CONT", low=2, text="fraction, expression")
def percentile_cont(args, where, distinct, order):
    return _percentile(args[1], args[0], where)


@aggregate("APPROX_QUANTILE", low=2, text="expression, fraction")
def approx_quantile(args, where, distinct, order):
    return _percentile(args[0], args[1], where)


def collected(v: Val, where, distinct, order) -> Column:
    """All values with nulls, in input order where an ordinal is given; distinct keeps the first of each."""
    one = F.struct(F.lit(0).alias("o"), v.col.alias("v")) if order is None else F.struct(order.alias("o"), v.col.alias("v"))
    rows = F.collect_list(_kept(one, where))
    values = F.transform(rows if order is None else F.sort_array(rows) if _sortable(v.type) else rows, lambda s: s["v"])
    return F.array_distinct(values) if distinct else values


def _sortable(t: T.DataType) -> bool:
    return not isinstance(t, (T.MapType, T.VariantType))


@aggregate("ARRAY_AGG", "LIST", "JSON_ARRAYAGG")
def array_agg(args, where, distinct, order):
    return collected(args[0], where, distinct, order)


@aggregate("STRING_AGG", low=2, text="expression, separator")
def string_agg(args, where, distinct, order):
    if args[1].literal is None:
        raise ArgumentError("The separator of STRING_AGG must be a literal")
    text = Val(as_text(args[0]), T.StringType())
    values = F.filter(collected(text, where, distinct, order), lambda s: s.isNotNull())
    return F.when(F.size(values) > 0, F.array_join(values, str(args[1].literal[0])))
