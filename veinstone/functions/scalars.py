"""Scalar functions: each builder lowers typed arguments to one column."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veinstone.functions.types import Val, as_double, as_text, as_time, common, compare
from veinstone.sql.errors import ArgumentError


@dataclass(frozen=True)
class Scalar:
    low: int
    high: int | None
    text: str
    build: Callable


REGISTRY: dict[str, Scalar] = {}


def scalar(*names: str, low: int = 1, high: int | None = -1, text: str = "value"):
    """Registers a function under its names; high None means any number of arguments."""

    def put(f):
        for n in names:
            REGISTRY[n] = Scalar(low, low if high == -1 else high, text, f)
        return f

    return put


# -- text --


def _text(v: Val) -> Column:
    return as_text(v, objects=False)


def _int(v: Val) -> Column:
    return as_double(v).cast("int")


def _checked(v: Val, least: int, name: str, what: str) -> Column:
    """An integer argument that raises when it is too small: at once if literal, per row otherwise."""
    if v.literal and v.literal[0] is not None:
        if not isinstance(v.literal[0], (int, float)) or isinstance(v.literal[0], bool) or v.literal[0] < least:
            raise ArgumentError(f"{name}: {what} must be at least {least}")
        return F.lit(int(v.literal[0]))
    n = _int(v)
    return F.when(n < least, F.raise_error(F.lit(f"{name}: {what} must be at least {least}")).cast("int")).otherwise(n)


@scalar("UPPER", text="string")
def upper(a):
    return F.upper(_text(a[0]))


@scalar("LOWER", text="string")
def lower(a):
    return F.lower(_text(a[0]))


@scalar("LENGTH", text="string")
def length(a):
    v = a[0]
    if v.is_array:
        return F.when(v.col.isNotNull(), F.size(v.col))
    if v.is_number or v.is_time:
        raise ArgumentError("LENGTH takes a string or an array")
    return F.length(_text(v))


@scalar("OCTET_LENGTH", text="string")
def octet_length(a):
    return F.octet_length(_text(a[0]))


@scalar("TRIM", text="string")
def trim(a):
    return F.regexp_replace(_text(a[0]), r"^[\s ﻿]+|[\s ﻿]+$", "")


@scalar("REPLACE", low=3, text="string, search, replacement")
def replace(a):
    s, search, new = map(_text, a)
    return F.when(search.isNotNull() & new.isNotNull(), F.replace(s, search, new))


@scalar("SUBSTRING", "SUBSTR", low=2, high=3, text="string, start[, length]")
def substring(a):
    start = _checked(a[1], 1, "SUBSTRING", "start")
    if len(a) == 2:
        return F.substring(_text(a[0]), start, F.lit(2**31 - 1))
    return F.substring(_text(a[0]), start, _checked(a[2], 0, "SUBSTRING", "length"))


@scalar("CONCAT", high=None, text="value1, value2[, ...]")
def concat(a):
    return F.concat(*map(_text, a))


@scalar("LEFT", low=2, text="string, length")
def left(a):
    return F.left(_text(a[0]), _checked(a[1], 0, "LEFT", "length"))


@scalar("RIGHT", low=2, text="string, length")
def right(a):
    return F.right(_text(a[0]), _checked(a[1], 0, "RIGHT", "length"))


@scalar("INSTR", "POSITION", "STRPOS", low=2, text="string, substring")
def instr(a):
    return F.call_function("instr", _text(a[0]), _text(a[1]))


@scalar("SPLIT_PART", low=3, text="string, delimiter, index")
def split_part(a):
    if a[2].literal and a[2].literal[0] == 0:
        raise ArgumentError("SPLIT_PART: index can't be 0")
    return F.split_part(_text(a[0]), _text(a[1]), _int(a[2]))


@scalar("STRING_SPLIT", low=2, text="string, delimiter")
def string_split(a):
    s, d = map(_text, a)
    if a[1].literal and isinstance(a[1].literal[0], str):
        d0 = a[1].literal[0]
        return F.split(s, re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", d0), -1) if d0 else F.when(s.isNotNull(), F.array(s))
    return F.when(d == "", F.array(s)).otherwise(F.split(s, F.concat(F.lit("\\Q"), d, F.lit("\\E")), -1))


def _from(s: Column, a, k: int, name: str) -> Column:
    return F.substring(s, _checked(a[k], 1, name, "position"), F.lit(2**31 - 1)) if len(a) > k else s


@scalar("REGEXP_SUBSTR", "REGEXP_EXTRACT", low=2, high=4, text="string, pattern[, position[, occurrence]]")
def regexp_substr(a):
    s = _from(_text(a[0]), a, 2, "REGEXP_SUBSTR")
    if len(a) < 4:
        return F.regexp_substr(s, _text(a[1]))
    nth = _checked(a[3], 1, "REGEXP_SUBSTR", "occurrence")
    return F.get(F.regexp_extract_all(s, _text(a[1]), F.lit(0)), nth - 1)


@scalar("REGEXP_REPLACE", low=3, high=5, text="string, pattern, replacement[, position[, occurrence]]")
def regexp_replace(a):
    s, pattern, new = (_text(v) for v in a[:3])
    if a[2].literal and isinstance(a[2].literal[0], str):
        new = F.lit(a[2].literal[0].replace("\\", "\\\\").replace("$&", "$0"))
    head, tail = F.lit(""), s
    if len(a) > 3:
        at = _checked(a[3], 1, "REGEXP_REPLACE", "position")
        head, tail = F.substring(s, F.lit(1), at - 1), F.substring(s, at, F.lit(2**31 - 1))
    nth = a[4].literal[0] if len(a) > 4 and a[4].literal else 0
    if len(a) > 4 and not a[4].literal:
        raise ArgumentError("REGEXP_REPLACE: occurrence must be a literal")
    if not nth:
        return F.concat(head, F.regexp_replace(tail, pattern, new))
    # The text between matches, and the matches: all stay but the nth, which becomes the literal replacement.
    found = F.regexp_extract_all(tail, pattern, F.lit(0))
    between = F.split(tail, pattern, -1)
    put = F.transform(found, lambda m, i: F.when(i == nth - 1, F.lit(a[2].literal[0]) if a[2].literal else new).otherwise(m))
    return F.concat(head, F.array_join(F.transform(between, lambda x, i: F.concat(x, F.coalesce(F.get(put, i), F.lit("")))), ""))


@scalar("REGEXP_MATCHES", "REGEXP_LIKE", low=2, text="string, pattern")
def regexp_like(a):
    return F.regexp_like(_text(a[0]), _text(a[1]))


# -- numbers --


def _unary(name: str, f: Callable, text: str = "number"):
    scalar(name, text=text)(lambda a: f(as_double(a[0])))


def _whole(x: Column, f: Callable) -> Column:
    """f(x) as a double; from 2**52 on, where doubles have no fractions, and for NaN and infinities x itself."""
    return F.when(F.abs(x) < 2.0**52, f(x).cast("double")).otherwise(x)


for _name, _f in {
    "FLOOR": lambda x: _whole(x, F.floor),
    "CEIL": lambda x: _whole(x, F.ceil),
    "CEILING": lambda x: _whole(x, F.ceil),
    "SIGN": F.signum,
    "EXP": F.exp,
    "SQRT": F.sqrt,
    "SIN": F.sin,
    "COS": F.cos,
    "TAN": F.tan,
    "COT": F.cot,
    "ASIN": F.asin,
    "ACOS": F.acos,
    "DEGREES": F.degrees,
    "RADIANS": F.radians,
    "LN": lambda x: F.when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(F.ln(x)),
    "LOG10": lambda x: F.when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(F.log10(x)),
}.items():
    _unary(_name, _f)


@scalar("ABS", text="number")
def absolute(a):
    return F.abs(a[0].col) if a[0].is_integer else F.abs(as_double(a[0]))


@scalar("ROUND", high=2, text="number[, decimals]")
def rounded(a):
    """Half rounds towards positive infinity."""
    x = as_double(a[0])
    if len(a) == 1:
        return _whole(x, lambda v: F.floor(v + 0.5))
    scale = F.lit(10.0 ** int(a[1].literal[0])) if a[1].literal and a[1].literal[0] is not None else F.pow(F.lit(10.0), as_double(a[1]))
    return F.when(F.abs(x * scale) < 2.0**52, F.floor(x * scale + 0.5).cast("double") / scale).otherwise(x)


@scalar("MOD", low=2, text="dividend, divisor")
def mod(a):
    x, y = as_double(a[0]), as_double(a[1])
    return F.when(x.isNotNull() & (y == 0), F.lit(float("nan"))).otherwise(F.try_mod(x, y))


@scalar("POWER", "POW", low=2, text="base, exponent")
def power(a):
    return F.pow(as_double(a[0]), as_double(a[1]))


@scalar("ATAN", high=2, text="number")
def atan(a):
    return F.atan(as_double(a[0])) if len(a) == 1 else F.atan2(as_double(a[0]), as_double(a[1]))


@scalar("ATAN2", low=2, text="y, x")
def atan2(a):
    return F.atan2(as_double(a[0]), as_double(a[1]))


@scalar("PI", low=0, text="")
def pi(a):
    return F.lit(math.pi)


@scalar("RAND", "RANDOM", low=0, text="")
def rand(a):
    return F.rand()


# -- dates --


def _utc(pattern: str) -> Column:
    """Now, written in UTC whatever the session's zone is."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), pattern)


@scalar("CURRENT_DATE", low=0, text="")
def current_date(a):
    return _utc("yyyy-MM-dd")


@scalar("CURRENT_TIME", low=0, text="")
def current_time(a):
    return _utc("HH:mm:ss.SSS")


@scalar("CURRENT_TIMESTAMP", low=0, text="")
def current_timestamp(a):
    return _utc("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def like_input(v: Val, made: Column) -> Column:
    """The kind of the input: text stays text, with a time only if the input has one."""
    if not v.is_text:
        return made
    return F.when(v.col.contains("T"), F.date_format(made, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).otherwise(F.date_format(made, "yyyy-MM-dd"))


@scalar("DATE_TRUNC", low=2, text="unit, date")
def date_trunc(a):
    unit = str(a[0].literal[0]).lower() if a[0].literal else None
    if unit is None:
        raise ArgumentError("DATE_TRUNC: unit must be a literal")
    t = as_time(a[1])
    return like_input(a[1], F.date_trunc(unit, t) if unit in ("year", "quarter", "month", "week", "day", "hour", "minute", "second") else t)


@scalar("DATE_PART", "EXTRACT", low=2, text="field, date")
def date_part(a):
    field = str(a[0].literal[0]).upper() if a[0].literal else ""
    t = as_time(a[1])
    parts = {"YEAR": F.year, "MONTH": F.month, "DAY": F.dayofmonth, "HOUR": F.hour, "MINUTE": F.minute, "SECOND": F.second, "DOW": lambda x: F.dayofweek(x) - 1, "EPOCH": lambda x: F.unix_micros(x) / 1e6}
    if field not in parts:
        raise ArgumentError(f"Unknown date field {field!r}")
    return parts[field](t)


@scalar("EPOCH", text="date")
def epoch(a):
    return F.unix_micros(as_time(a[0])) / 1e6


@scalar("DATE_DIFF", "DATEDIFF", low=3, text="unit, start, end")
def date_diff(a):
    unit = str(a[0].literal[0]).upper().rstrip("S") if a[0].literal else ""
    s, e = as_time(a[1]), as_time(a[2])
    if unit == "YEAR":
        return F.year(e) - F.year(s)
    if unit == "MONTH":
        return (F.year(e) - F.year(s)) * 12 + F.month(e) - F.month(s)
    sizes = {"WEEK": 604_800, "DAY": 86_400, "HOUR": 3600, "MINUTE": 60, "SECOND": 1}
    if unit not in sizes:
        raise ArgumentError(f"Unknown date unit {unit!r}")
    gap = (F.unix_micros(e) - F.unix_micros(s)) / F.lit(sizes[unit] * 1e6)
    return F.when(gap < 0, F.ceil(gap)).otherwise(F.floor(gap)).cast("long")


def add_interval(v: Val, amount: float, unit: str) -> Column:
    """A date moved by an interval; months past a month's end run into the next one."""
    t = as_time(v)
    if unit in ("MONTH", "YEAR"):
        months = int(amount) * (12 if unit == "YEAR" else 1)
        first = F.date_trunc("month", t)
        moved = F.add_months(first, months).cast("timestamp")
        made = F.timestamp_micros(F.unix_micros(moved) + F.unix_micros(t) - F.unix_micros(first))
    else:
        size = {"DAY": 86_400, "HOUR": 3600, "MINUTE": 60, "SECOND": 1}[unit]
        made = F.timestamp_micros(F.unix_micros(t) + F.lit(int(amount * size * 1_000_000)))
    return like_input(v, made)


# -- JSON --


def _steps(path: str) -> list:
    """$.a.b[0] as ['a', 'b', 0]; the leading $ is optional."""
    path = path.strip()
    path = path[1:] if path.startswith("$") else "." + path if path and path[0] not in ".[" else path
    out: list = []
    while path:
        m = re.match(r"\.([^.\[\]]+)|\[(\d+)\]|\[['\"](.+?)['\"]\]|\.\"(.+?)\"", path)
        if not m:
            raise ArgumentError(f"Invalid JSON path {path!r}")
        out.append(int(m[2]) if m[2] is not None else m[1] or m[3] or m[4])
        path = path[m.end() :]
    return out


def json_path(a, text_only: bool = False) -> Column:
    """What the path names. Structs, maps and arrays keep their types; JSON text gives the scalar's text."""
    v, p = a
    if p.literal and p.literal[0] is None:
        return F.lit(None).cast("string")
    if not p.literal or not isinstance(p.literal[0], str):
        raise ArgumentError("The JSON path must be a literal")
    steps = _steps(p.literal[0])
    c, t = v.col, v.type
    while steps and not isinstance(t, (T.StringType, T.VariantType)):
        s = steps[0]
        if isinstance(t, T.StructType) and isinstance(s, str):
            if s not in t.fieldNames():
                return F.lit(None).cast("string")
            c, t = c.getField(s), t[s].dataType
        elif isinstance(t, T.MapType) and isinstance(s, str):
            c, t = F.try_element_at(c, F.lit(s)), t.valueType
        elif isinstance(t, T.ArrayType) and isinstance(s, int):
            c, t = F.get(c, F.lit(s)), t.elementType
        else:
            return F.lit(None).cast("string")
        steps = steps[1:]
    if not isinstance(t, (T.StringType, T.VariantType)):
        return as_text(Val(c, t)) if text_only else c
    if not steps and isinstance(t, T.StringType) and c is not v.col:
        return c
    rest = "$" + "".join(f"[{s}]" if isinstance(s, int) else f"['{s}']" for s in steps)
    return F.try_variant_get(F.parse_json(c) if isinstance(t, T.StringType) else c, rest, "string")


@scalar("JSON_VALUE", "JSON_QUERY", "JSON_EXTRACT", low=2, text="expression, path")
def json_value(a):
    return json_path(a)


@scalar("JSON_EXTRACT_STRING", low=2, text="expression, path")
def json_extract_string(a):
    return json_path(a, True)


@scalar("JSON_OBJECT", low=0, high=None, text="key1, value1[, ...]")
def json_object(a):
    if len(a) % 2:
        raise ArgumentError("JSON_OBJECT takes pairs of keys and values")
    if not a:
        return F.lit("{}")
    keys = a[::2]
    if any(k.literal and k.literal[0] is None for k in keys):
        raise ArgumentError("A key of JSON_OBJECT can't be null")
    if all(k.literal for k in keys):
        return F.struct(*[v.col.alias(str(k.literal[0])) for k, v in zip(keys, a[1::2])])
    return F.create_map(*[x for k, v in zip(keys, a[1::2]) for x in (_text(k), as_text(v))])


def _variant(v: Val) -> Column:
    return v.col if isinstance(v.type, T.VariantType) else F.parse_json(v.col)


@scalar("JSON_ARRAY_LENGTH", text="array")
def json_array_length(a):
    v = a[0]
    if v.is_array:
        return F.when(v.col.isNotNull(), F.size(v.col))
    if not v.is_text:
        return F.lit(None).cast("int")
    return F.when(F.parse_json(v.col).isNotNull(), F.json_array_length(v.col))


@scalar("JSON_VALID", text="value")
def json_valid(a):
    v = a[0]
    if v.is_null:
        return F.lit(None).cast("boolean")
    return F.when(v.col.isNotNull(), F.try_parse_json(v.col).isNotNull() if v.is_text else F.lit(False))


@scalar("JSON_TYPE", text="value")
def json_type(a):
    v = a[0]
    fixed = "array" if v.is_array else "object" if isinstance(v.type, (T.StructType, T.MapType)) else "number" if v.is_number else "boolean" if v.is_bool else None
    if fixed:
        return F.when(v.col.isNotNull(), F.lit(fixed))
    if v.is_null or v.is_time:
        return F.lit(None).cast("string")
    kind = F.schema_of_variant(_variant(v))
    return (
        F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").when(kind.isNotNull(), "number")
    )


@scalar("JSON_KEYS", text="value")
def json_keys(a):
    v = a[0]
    if isinstance(v.type, T.StructType):
        return F.when(v.col.isNotNull(), F.array(*[F.lit(n) for n in v.type.fieldNames()]))
    if isinstance(v.type, T.MapType):
        return F.map_keys(v.col)
    if not v.is_text:
        return F.lit(None).cast("array<string>")
    return F.when(F.parse_json(v.col).isNotNull(), F.json_object_keys(v.col))


# -- arrays --


@scalar("ARRAY_LENGTH", high=2, text="array[, dimension]")
def array_length(a):
    v = a[0]
    if not v.is_array:
        return F.lit(None).cast("int")
    size = F.when(v.col.isNotNull(), F.size(v.col))
    if len(a) == 1:
        return size
    dim = a[1].literal[0] if a[1].literal else None
    if not isinstance(dim, int):
        raise ArgumentError("The dimension must be an integer literal")
    if dim < 1:
        return F.lit(None).cast("int")
    c, t = v.col, v.type
    for _ in range(dim - 1):
        if not isinstance(t.elementType, T.ArrayType):
            return F.lit(None).cast("int")
        sizes = F.array_distinct(F.transform(c, lambda x: F.size(x)))
        c, t = F.when(F.size(sizes) == 1, F.flatten(c)), t.elementType
        size = F.when(F.size(sizes) == 1, F.get(sizes, F.lit(0)))
    return size


@scalar("LIST_LENGTH", "LEN", "CARDINALITY", "SIZE", text="array")
def list_length(a):
    return array_length(a)


def _element(a) -> tuple[Column, Column]:
    v, e = a
    t = v.type.elementType
    return v.col, (e.col.cast(t) if e.is_number and isinstance(t, T.NumericType) or e.is_null else e.col)


def _same_kind(a) -> bool:
    v, e = a
    if not v.is_array:
        return False
    t = Val(v.col, v.type.elementType)
    return e.is_null or t.is_null or t.is_number == e.is_number and t.is_text == e.is_text and t.is_bool == e.is_bool


@scalar("ARRAY_POSITION", "LIST_POSITION", low=2, text="array, element")
def array_position(a):
    if not _same_kind(a):
        return F.lit(None).cast("long")
    c, e = _element(a)
    return F.nullif(F.array_position(c, e), F.lit(0).cast("long"))


@scalar("ARRAY_CONTAINS", "LIST_CONTAINS", low=2, text="array, element")
def array_contains(a):
    if not a[0].is_array:
        return F.lit(None).cast("boolean")
    if not _same_kind(a):
        return F.when(a[0].col.isNotNull(), F.lit(False))
    c, e = _element(a)
    return F.when(c.isNotNull(), F.coalesce(F.array_contains(c, e), F.lit(False)))


@scalar("ARRAY_APPEND", "LIST_APPEND", low=2, text="array, element")
def array_append(a):
    if not a[0].is_array:
        return F.lit(None).cast("array<string>")
    return F.array_append(*_element(a)) if _same_kind(a) else F.array_append(F.transform(a[0].col, lambda x: as_text(Val(x, a[0].type.elementType))), as_text(a[1]))


@scalar("ARRAY_CONCAT", "LIST_CONCAT", low=2, text="array1, array2")
def array_concat(a):
    return F.concat(a[0].col, a[1].col) if a[0].is_array and a[1].is_array else F.lit(None).cast("array<string>")


@scalar("ARRAY_SORT", text="array")
def array_sort(a):
    return F.array_sort(a[0].col) if a[0].is_array else F.lit(None).cast("array<string>")


# -- conditions --


@scalar("COALESCE", high=None, text="value1, value2[, ...]")
def coalesce(a):
    return F.coalesce(*common(a))


@scalar("NULLIF", low=2, text="value1, value2")
def nullif(a):
    return F.when(F.coalesce(compare("=", a[0], a[1]), F.lit(False)), F.lit(None)).otherwise(a[0].col)


@scalar("GREATEST", high=None, text="value1[, value2, ...]")
def greatest(a):
    return F.greatest(*common(a)) if len(a) > 1 else a[0].col


@scalar("LEAST", high=None, text="value1[, value2, ...]")
def least(a):
    return F.least(*common(a)) if len(a) > 1 else a[0].col


from veinstone.spatial import functions as _spatial  # noqa: E402  registers the ST_ functions

assert _spatial
