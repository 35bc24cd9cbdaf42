"""Typed expressions and the dialect's coercions between types."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veinstone.sql.errors import ArgumentError


@dataclass
class Val:
    """A column with its type; literal holds the value if it is one, wrapped in a tuple."""

    col: Column
    type: T.DataType
    literal: tuple | None = None

    @property
    def is_text(self) -> bool:
        return isinstance(self.type, (T.StringType, T.VarcharType, T.CharType))

    @property
    def is_number(self) -> bool:
        return isinstance(self.type, T.NumericType)

    @property
    def is_integer(self) -> bool:
        return isinstance(self.type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))

    @property
    def is_bool(self) -> bool:
        return isinstance(self.type, T.BooleanType)

    @property
    def is_time(self) -> bool:
        return isinstance(self.type, (T.TimestampType, T.TimestampNTZType, T.DateType))

    @property
    def is_array(self) -> bool:
        return isinstance(self.type, T.ArrayType)

    @property
    def is_object(self) -> bool:
        return isinstance(self.type, (T.StructType, T.MapType, T.VariantType))

    @property
    def is_null(self) -> bool:
        return isinstance(self.type, T.NullType)


def literal(value: Any) -> Val:
    if value is None:
        return Val(F.lit(None), T.NullType(), (None,))
    if isinstance(value, bool):
        return Val(F.lit(value), T.BooleanType(), (value,))
    if isinstance(value, int):
        if -(2**31) <= value < 2**31:
            return Val(F.lit(value), T.IntegerType(), (value,))
        if -(2**63) <= value < 2**63:
            return Val(F.lit(value), T.LongType(), (value,))
        return Val(F.lit(float(value)), T.DoubleType(), (float(value),))
    if isinstance(value, float):
        return Val(F.lit(value), T.DoubleType(), (value,))
    return Val(F.lit(value), T.StringType(), (value,))


def try_double(c: Column) -> Column:
    return c.try_cast("double")


def as_double(v: Val) -> Column:
    """The number a value stands for, null if none."""
    if v.is_number:
        return v.col.cast("double")
    if v.is_bool:
        return v.col.cast("int").cast("double")
    if v.is_time:
        return F.unix_micros(v.col.cast("timestamp")) / F.lit(1000.0)
    if v.is_null:
        return F.lit(None).cast("double")
    if isinstance(v.type, T.VariantType):
        return F.try_variant_get(v.col, "$", "double")
    if v.is_text:
        return try_double(F.trim(v.col))
    return F.lit(None).cast("double")


def as_number(v: Val) -> Val:
    """Integers stay exact; all else becomes a double."""
    if v.is_integer:
        return Val(v.col.cast("long"), T.LongType(), v.literal)
    return Val(as_double(v), T.DoubleType(), v.literal)


def as_bool(v: Val) -> Column:
    """Truthiness: zero, NaN and empty text are false, null stays null."""
    if v.is_bool:
        return v.col
    if v.is_number:
        plain = v.col != 0
        return plain & ~F.isnan(v.col) if isinstance(v.type, (T.DoubleType, T.FloatType)) else plain
    if v.is_text:
        return v.col != ""
    if v.is_null:
        return F.lit(None).cast("boolean")
    return F.when(v.col.isNotNull(), True)


def as_text(v: Val, objects: bool = True) -> Column:
    """The text form: whole doubles have no fraction, objects are JSON."""
    if v.is_text:
        return v.col
    if isinstance(v.type, (T.DoubleType, T.FloatType)):
        whole = (v.col == F.floor(v.col)) & (F.abs(v.col) < 1e15)
        return F.when(whole, v.col.cast("long").cast("string")).otherwise(v.col.cast("string"))
    if v.is_time:
        if isinstance(v.type, T.DateType):
            return F.date_format(v.col, "yyyy-MM-dd")
        return F.date_format(v.col, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    if v.is_array or v.is_object:
        if not objects:
            raise ArgumentError("An object or array can't be used as text here; use CAST")
        return F.to_json(v.col)
    return v.col.cast("string")


def as_time(v: Val) -> Column:
    """A timestamp; unreadable text gives null, numbers are milliseconds."""
    if v.is_time:
        return v.col.cast("timestamp")
    if v.is_text:
        return v.col.try_cast("timestamp")
    if v.is_number:
        return F.timestamp_millis(v.col.cast("long"))
    return F.lit(None).cast("timestamp")


def compare(op: str, a: Val, b: Val) -> Column:
    """A loose comparison: null if either side is, false where the sides can't meet."""
    x, y = a.col, b.col
    if a.is_null or b.is_null:
        return F.lit(None).cast("boolean")
    loose = False
    if a.is_time or b.is_time:
        if not (a.is_time and b.is_time):
            loose = True
            x, y = as_time(a), as_time(b)
        else:
            x, y = a.col.cast("timestamp"), b.col.cast("timestamp")
    elif (a.is_number or a.is_bool) and (b.is_text or isinstance(b.type, T.VariantType)) or (b.is_number or b.is_bool) and (a.is_text or isinstance(a.type, T.VariantType)):
        loose = True
        x, y = as_double(a), as_double(b)
    elif a.is_bool != b.is_bool and (a.is_number or b.is_number):
        x, y = as_double(a), as_double(b)
    elif isinstance(a.type, T.VariantType) or isinstance(b.type, T.VariantType):
        x, y = as_text(a), as_text(b)
    elif a.is_object or b.is_object:
        x, y = as_text(a), as_text(b)
    made = {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
    if loose:
        made = F.when(a.col.isNotNull() & b.col.isNotNull(), F.coalesce(made, F.lit(op == "<>")))
    return made


def common(values: list[Val]) -> list[Column]:
    """Columns brought to one type: of mixed types, text if there is any."""
    kinds = {("number" if v.is_number else "bool" if v.is_bool else "text" if v.is_text else str(v.type)) for v in values if not v.is_null}
    if len(kinds) <= 1:
        if kinds == {"number"} and any(isinstance(v.type, (T.DoubleType, T.FloatType)) for v in values):
            return [v.col.cast("double") for v in values]
        return [v.col for v in values]
    return [F.lit(None).cast("string") if v.is_null else as_text(v) for v in values]
