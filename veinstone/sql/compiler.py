"""Compiles a syntax tree to a DataFrame.

Every relation's columns get names that are unique in the query, and a scope
says which written name means which of them; so self joins, equal names and
names with dots or spaces need no care later, and all planning is Catalyst's.
"""

from __future__ import annotations

import difflib
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veinstone.functions import aggregates, scalars
from veinstone.functions.catalog import AGGREGATES
from veinstone.functions.types import Val, as_bool, as_double, as_number, as_text, as_time, common, compare, literal
from veinstone.operators.ordinal import exact_percentile, positional_join, with_ordinal
from veinstone.sql import nodes as N
from veinstone.sql.errors import ArgumentError, ColumnNotFoundError, ParseError, PlanError, TableNotFoundError
from veinstone.sql.visitors import derived_alias, find_aggregates, find_windows

_FRAMES: dict = {}
PERCENTILES = ("MEDIAN", "PERCENTILE_CONT", "APPROX_QUANTILE")
LOCAL = "\0"  # the prefix of names that are resolved to a unique column


@dataclass
class Entry:
    qualifier: str | None
    name: str
    id: str
    type: T.DataType


@dataclass
class Scope:
    df: DataFrame
    entries: list[Entry]
    outer: "Scope | None" = None

    def find(self, name: str, prefix: str | None) -> Entry | None:
        return next((e for e in self.entries if e.name == name and (prefix is None or e.qualifier == prefix)), None)

    def typing(self, spark: SparkSession, *more: str) -> DataFrame:
        """An empty frame of these columns, to ask the analyzer for types: no data and no outer names."""
        key = (tuple((e.id, e.type.json()) for e in self.entries), more)
        if key not in _FRAMES:
            if len(_FRAMES) > 500:
                _FRAMES.clear()
            fields = [T.StructField(e.id, e.type) for e in self.entries] + [T.StructField(m, T.LongType()) for m in more]
            _FRAMES[key] = (spark, spark.createDataFrame([], T.StructType(fields)) if fields else spark.range(0))
        if _FRAMES[key][0] is not spark:
            del _FRAMES[key]
            return self.typing(spark, *more)
        return _FRAMES[key][1]

    def by_id(self, i: str) -> Entry:
        return next(e for e in self.entries if e.id == i)


@dataclass
class Lowering:
    """Turns expressions over one scope into columns. known: nodes whose value is at hand already."""

    compiler: "Compiler"
    scope: Scope
    ctes: dict
    known: dict = field(default_factory=dict)
    types: dict = field(default_factory=dict)
    ordinal: str | None = None
    probing: bool = False
    #: Of windows without PARTITION BY: the value, and whether there is a row to take it from.
    moved: dict = field(default_factory=dict)

    # -- names --

    def resolve(self, e: Any) -> Any:
        """Written names become resolved ones; a dot into a struct becomes a subscript."""
        return N.rewrite(e, lambda n: self._resolved(n) if isinstance(n, N.Name) and n.prefix != LOCAL else None)

    def _resolved(self, n: N.Name) -> N.Node:
        entry = self.scope.find(n.name, n.prefix)
        if entry:
            return N.Name(entry.id, LOCAL, start=n.start, end=n.end)
        if n.prefix is not None:
            dotted = self.scope.find(f"{n.prefix}.{n.name}", None)
            if dotted:
                return N.Name(dotted.id, LOCAL, start=n.start, end=n.end)
            # A struct column, or the alias of a table function that yields structs.
            base = self.scope.find(n.prefix, None) or next((e for e in self.scope.entries if e.qualifier == n.prefix and isinstance(e.type, T.StructType) and n.name in e.type.fieldNames()), None)
            if base:
                return N.Subscript(N.Name(base.id, LOCAL, start=n.start, end=n.end), N.Literal(n.name), start=n.start, end=n.end)
        outer = self.scope.outer
        while outer:
            if outer.find(n.name, n.prefix) or n.prefix and outer.find(n.prefix, None):
                return n
            outer = outer.outer
        known = [e.name for e in self.scope.entries]
        near = difflib.get_close_matches(n.name, known, 1)
        written = f"{n.prefix}.{n.name}" if n.prefix else n.name
        raise ColumnNotFoundError(f"Column {written!r} not found" + (f"; did you mean {near[0]!r}?" if near else f"; available: {', '.join(dict.fromkeys(known))}"), n.start, n.end)

    # -- values --

    def val(self, e: N.Node) -> Val:
        if e in self.known:
            return self.known[e]
        made = getattr(self, "v_" + type(e).__name__.lower())(e)
        return made

    def column(self, e: N.Node) -> Column:
        return self.val(e).col

    def typed(self, e: N.Node, col: Column) -> Val:
        """A column with the type that Spark's analyzer gives it, asked once per expression."""
        if e not in self.types:
            if self.probing or not self._has_outer(e):
                frame = self.scope.typing(self.compiler.spark, *([self.ordinal] if self.ordinal else []))
                self.types[e] = frame.select(col.alias("x")).schema[0].dataType
            else:
                probe = replace(self, probing=True, types=dict(self.types))
                self.types[e] = probe.val(e).type
        return Val(col, self.types[e])

    def _has_outer(self, e: N.Node) -> bool:
        return any(isinstance(n, N.Name) and n.prefix != LOCAL for n in N.walk(e, True)) and self.scope.outer is not None

    def v_name(self, e: N.Name) -> Val:
        if e.prefix == LOCAL:
            entry = self.scope.by_id(e.name)
            return Val(F.col(entry.id), entry.type)
        outer = self.scope.outer
        while outer:
            entry = outer.find(e.name, e.prefix)
            step = None
            if not entry and e.prefix and (entry := outer.find(e.prefix, None)):
                step = e.name
            if entry:
                col, t = (F.lit(None).cast(entry.type) if self.probing else F.col(entry.id).outer()), entry.type
                return Val(col.getField(step), t[step].dataType) if step else Val(col, t)
            outer = outer.outer
        return self.val(self._resolved(e))

    def v_literal(self, e: N.Literal) -> Val:
        if e.kind == "timestamp":
            return Val(F.lit(e.value).try_cast("timestamp"), T.TimestampType())
        return literal(e.value)

    def v_arrayliteral(self, e: N.ArrayLiteral) -> Val:
        items = [self.val(x) for x in e.items]
        return self.typed(e, F.array(*common(items)) if items else F.array().cast("array<string>"))

    def v_interval(self, e: N.Interval) -> Val:
        raise PlanError("An INTERVAL can only be added to or taken from a date", e.start, e.end)

    def v_star(self, e: N.Star) -> Val:
        raise ParseError("* is not allowed here", e.start, e.end)

    def v_unary(self, e: N.Unary) -> Val:
        v = self.val(e.arg)
        if e.op == "NOT":
            return Val(~as_bool(v), T.BooleanType())
        if v.literal and isinstance(v.literal[0], (int, float)) and not isinstance(v.literal[0], bool):
            return literal(-v.literal[0])
        n = as_number(v)
        return Val(-n.col, n.type)

    def v_binary(self, e: N.Binary) -> Val:
        if e.op in ("AND", "OR"):
            a, b = as_bool(self.val(e.left)), as_bool(self.val(e.right))
            return Val(a & b if e.op == "AND" else a | b, T.BooleanType())
        if e.op in "+-" and isinstance(e.right, N.Interval):
            v = self.val(e.left)
            amount = e.right.value if e.op == "+" else -e.right.value
            return Val(scalars.add_interval(v, amount, e.right.unit), T.StringType() if v.is_text else T.TimestampType())
        if e.op == "+" and isinstance(e.left, N.Interval):
            return self.v_binary(N.Binary("+", e.right, e.left))
        a, b = self.val(e.left), self.val(e.right)
        if e.op == "||":
            return Val(F.concat(as_text(a), as_text(b)), T.StringType())
        if e.op == "LIKE":
            return Val(self.like(a, b), T.BooleanType())
        if e.op in ("+", "-", "*", "/", "%"):
            x, y = as_number(a), as_number(b)
            if e.op == "/":
                return Val(F.try_divide(x.col.cast("double"), y.col.cast("double")), T.DoubleType())
            made = {"+": lambda: x.col + y.col, "-": lambda: x.col - y.col, "*": lambda: x.col * y.col, "%": lambda: F.try_mod(x.col, y.col)}[e.op]()
            both = isinstance(x.type, T.LongType) and isinstance(y.type, T.LongType)
            return Val(made, T.LongType() if both else T.DoubleType())
        return Val(compare(e.op, a, b), T.BooleanType())

    def like(self, a: Val, b: Val) -> Column:
        """Ignores case, crosses line breaks and knows no escape character."""
        if b.literal and isinstance(b.literal[0], str):
            words = b.literal[0].strip("%")
            if words and words.isascii() and not set(words) & set("%_"):  # marks at the ends only: no regular expression
                low, part = F.lower(as_text(a)), words.lower()
                head, tail = b.literal[0].startswith("%"), b.literal[0].endswith("%")
                return low.contains(part) if head and tail else low.endswith(part) if head else low.startswith(part) if tail else low == part
            special = set("\\.^$|?*+()[]{}")
            pattern = "".join(".*" if c == "%" else "." if c == "_" else "\\" + c if c in special else c for c in b.literal[0])
            return F.rlike(as_text(a), F.lit(f"(?isu)\\A{pattern}\\z"))
        return F.call_function("ilike", as_text(a), F.replace(as_text(b), F.lit("\\"), F.lit("\\\\")))

    def v_isnull(self, e: N.IsNull) -> Val:
        c = self.column(e.arg)
        return Val(c.isNotNull() if e.negated else c.isNull(), T.BooleanType())

    def v_inlist(self, e: N.InList) -> Val:
        a = self.val(e.arg)
        items = [self.val(x) for x in e.items]
        plain = all(i.literal and i.literal[0] is not None for i in items) and (a.is_text and all(i.is_text for i in items) or a.is_number and all(i.is_number for i in items))
        if plain:
            return Val(a.col.isin([i.literal[0] for i in items]), T.BooleanType())
        out = compare("=", a, items[0])
        for i in items[1:]:
            out = out | compare("=", a, i)
        return Val(out, T.BooleanType())

    def sub(self, query: N.Node) -> tuple[DataFrame, list[Entry]]:
        return self.compiler.query(query, self.ctes, self.scope)

    def v_inquery(self, e: N.InQuery) -> Val:
        if self.probing:
            return Val(F.lit(None).cast("boolean"), T.BooleanType())
        a = self.val(e.arg)
        df, out = self.sub(e.query)
        if len(out) != 1:
            raise PlanError("IN takes a subquery of one column", e.start, e.end)
        left, b = a.col, Val(F.col(out[0].id), out[0].type)
        if a.is_text != b.is_text or a.is_time != b.is_time:
            if a.is_time or b.is_time:
                left, df = as_time(a), df.select(as_time(b).alias(out[0].id))
            elif a.is_number or b.is_number:
                left, df = as_double(a), df.select(as_double(b).alias(out[0].id))
            else:
                left, df = as_text(a), df.select(as_text(b).alias(out[0].id))
        return Val(left.isin(df), T.BooleanType())

    def v_exists(self, e: N.Exists) -> Val:
        if self.probing:
            return Val(F.lit(None).cast("boolean"), T.BooleanType())
        return Val(self.sub(e.query)[0].exists(), T.BooleanType())

    def v_scalar(self, e: N.Scalar) -> Val:
        q = e.query
        one = isinstance(q, N.Select) and not q.group and q.offset is None and bool(find_aggregates([i.expr for i in q.items]))
        df, out = self.sub(q if one else first_row(q))
        if self.probing:
            return Val(F.lit(None).cast(out[0].type), out[0].type)
        return Val(df.select(out[0].id).scalar(), out[0].type)

    def v_case(self, e: N.Case) -> Val:
        results = [self.val(r) for _, r in e.whens] + ([self.val(e.otherwise)] if e.otherwise is not None else [])
        cols = common(results)
        base = self.val(e.base) if e.base is not None else None
        out = None
        for (cond, _), col in zip(e.whens, cols):
            c = self.val(cond)
            if base is None:
                test = as_bool(c)
            else:  # null meets null
                test = F.coalesce(compare("=", base, c), F.lit(False)) | (base.col.isNull() & c.col.isNull())
            out = F.when(test, col) if out is None else out.when(test, col)
        if e.otherwise is not None:
            out = out.otherwise(cols[-1])
        return self.typed(e, out)

    def v_cast(self, e: N.Cast) -> Val:
        v = self.val(e.arg)
        kind = e.to
        if kind in ("TEXT", "STRING", "VARCHAR"):
            if e.safe and (v.is_object or v.is_array):
                return Val(F.lit(None).cast("string"), T.StringType())
            return Val(as_text(v), T.StringType())
        if kind in ("INTEGER", "INT", "BIGINT"):
            if v.is_integer:
                return Val(v.col.cast("long"), T.LongType(), v.literal)
            return Val(as_double(v).try_cast("long"), T.LongType())
        if kind in ("FLOAT", "REAL", "DOUBLE"):
            return Val(as_double(v), T.DoubleType())
        if kind in ("BOOLEAN", "BOOL"):
            return Val(as_bool(v), T.BooleanType())
        return Val(as_time(v), T.TimestampType())

    def v_subscript(self, e: N.Subscript) -> Val:
        v, i = self.val(e.arg), self.val(e.index)
        if v.is_array:
            return self.typed(e, F.get(v.col, i.col.cast("int"))) if i.is_number else self.typed(e, F.lit(None).cast("string"))
        key = i.literal[0] if i.literal else None
        if isinstance(v.type, T.StructType):
            if isinstance(key, str) and key in v.type.fieldNames():
                return Val(v.col.getField(key), v.type[key].dataType)
            return Val(F.lit(None).cast("string"), T.StringType())
        if isinstance(v.type, T.MapType):
            return Val(F.try_element_at(v.col, as_text(i)), v.type.valueType)
        if (v.is_text or isinstance(v.type, T.VariantType)) and key is not None:
            path = f"$[{key}]" if isinstance(key, int) else f"$['{key}']"
            return Val(F.try_variant_get(F.try_parse_json(v.col) if v.is_text else v.col, path, "string"), T.StringType())
        return Val(F.lit(None).cast("string"), T.StringType())

    def v_call(self, e: N.Call) -> Val:
        if e.name in AGGREGATES:
            raise PlanError(f"Aggregate function {e.name} is not available here", e.start, e.end)
        args = [self.val(a) for a in e.args]
        if e.name in scalars.REGISTRY:
            try:
                return self.typed(e, scalars.REGISTRY[e.name].build(args))
            except ArgumentError as x:
                raise ArgumentError(x.message, e.start, e.end) from None
        return self.typed(e, self.compiler.functions[e.name].build([a.col for a in args]))

    def aggregate(self, e: N.Call) -> Column:
        for a in (*e.args, e.where):
            if a is not None and (find_aggregates(a) or find_windows(a)):
                raise PlanError(f"{e.name} can't hold another aggregate or window function", e.start, e.end)
        args = [None if isinstance(a, N.Star) else self.val(a) for a in e.args]
        where = as_bool(self.val(e.where)) if e.where is not None else None
        order = F.col(self.ordinal) if self.ordinal else None
        try:
            return aggregates.REGISTRY[e.name].build(args, where, e.distinct, order)
        except ArgumentError as x:
            raise ArgumentError(x.message, e.start, e.end) from None

    def sort_keys(self, order: tuple) -> list[Column]:
        out = []
        for o in order:
            c = self.column(o.expr)
            if o.descending:
                out.append(c.desc_nulls_last() if o.nulls_last else c.desc_nulls_first())
            else:
                out.append(c.asc_nulls_last() if o.nulls_last else c.asc_nulls_first())
        return out

    def v_window(self, e: N.Window) -> Val:
        ordinal = F.col(self.ordinal)
        if e.name == "ROW_NUMBER" and not e.partition and not e.order:
            return Val(ordinal + 1, T.LongType())
        w = W.partitionBy(*[self.column(p) for p in e.partition]).orderBy(*self.sort_keys(e.order), ordinal)
        if e.name == "ROW_NUMBER":
            return Val(self.moved[e][0] if e in self.moved else F.row_number().over(w).cast("long"), T.LongType())
        v = self.val(e.args[0])
        step = self.val(e.args[1]) if len(e.args) > 1 else literal(1)
        default = self.val(e.args[2]) if len(e.args) > 2 else None
        sign = -1 if e.name == "LAG" else 1
        if e in self.moved:
            moved, here = self.moved[e]
            if default is None:
                return Val(moved, v.type)
        elif step.literal and isinstance(step.literal[0], int):
            k = sign * step.literal[0]
            moved = F.lead(v.col, k).over(w) if k >= 0 else F.lag(v.col, -k).over(w)
            if default is None:
                return Val(moved, v.type)
            here = F.lead(F.lit(1), k).over(w) if k >= 0 else F.lag(F.lit(1), -k).over(w)
        else:  # an offset that changes by row: look it up among the partition's values
            all_rows = F.collect_list(F.struct(v.col.alias("v"))).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
            at = F.row_number().over(w) - 1 + sign * as_double(step).cast("int")
            found = F.when(at >= 0, F.get(all_rows, at))
            moved, here = found.getField("v"), found
            if default is None:
                return Val(moved, v.type)
        a, b = common([v, default])
        moved = moved.cast("double") if v.is_number and self._float(a, e, v, default) else moved if v.is_text or not default.is_text else as_text(Val(moved, v.type))
        out = F.when(here.isNotNull(), moved).otherwise(b)
        return Val(out, replace(self, moved={}).v_window(e).type) if e in self.moved else self.typed(e, out)

    @staticmethod
    def _float(a, e, v: Val, d: Val) -> bool:
        return d.is_number and isinstance(d.type, (T.DoubleType, T.FloatType)) or isinstance(v.type, (T.DoubleType, T.FloatType))


class Compiler:
    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], functions: dict | None = None):
        self.spark, self.tables, self.functions = spark, tables, functions or {}
        self.made = 0

    def fresh(self) -> str:
        self.made += 1
        return f"c{self.made}"

    # -- relations --

    def rename(self, df: DataFrame, names: list[str], qualifier: str | None) -> Scope:
        """df with unique column names, in positional order."""
        entries = [Entry(qualifier, n, self.fresh(), f.dataType) for n, f in zip(names, df.schema.fields)]
        return Scope(df.toDF(*[e.id for e in entries]), entries)

    def single_row(self) -> Scope:
        return Scope(self.spark.range(1).select(F.lit(0).alias(self.fresh())), [])

    def relation(self, node: N.Node, ctes: dict, outer: Scope | None) -> Scope:
        if isinstance(node, N.Table):
            if node.name.lower() in ctes:
                query, inner = ctes[node.name.lower()]
                df, out = self.query(query, inner, None)
                return Scope(df, [replace(e, qualifier=node.alias or node.name) for e in out])
            if node.name not in self.tables:
                near = difflib.get_close_matches(node.name, self.tables, 1)
                raise TableNotFoundError(f"Table {node.name!r} not found" + (f"; did you mean {near[0]!r}?" if near else f"; available: {', '.join(self.tables)}"), node.start, node.end)
            df = self.tables[node.name]
            return self.rename(df, df.columns, node.alias or node.name)
        if isinstance(node, N.Derived):
            df, out = self.query(node.query, ctes, outer)
            return Scope(df, [replace(e, qualifier=node.alias) for e in out])
        return self.lateral(self.single_row(), N.Join("lateral", node), ctes, outer)

    def lateral(self, left: Scope, join: N.Join, ctes: dict, outer: Scope | None) -> Scope:
        """left with the rows a table function makes of each of its rows."""
        f = join.right
        low = Lowering(self, replace(left, outer=outer), ctes)
        v = low.val(low.resolve(f.args[0]))
        ids = [self.fresh() for _ in f.columns]

        def listed(v: Val) -> Column:
            if f.name == "JSON_EACH":
                return self.json_pairs(v)
            return v.col if v.is_array else F.array().cast("array<string>")

        # The argument is a column of its own first: it may be a subquery, which lambdas can't hold.
        given = self.fresh()
        rows = listed(Val(F.col(given), v.type, v.literal))
        keep_left = join.kind == "lateral_left"
        temp = self.fresh()
        made = left.df.withColumn(given, v.col).withColumn(temp, rows)
        probe = replace(low, probing=True, types=dict(low.types))
        element = left.typing(self.spark).select(listed(probe.val(low.resolve(f.args[0]))).alias(temp)).schema[temp].dataType.elementType
        pairs = f.name == "JSON_EACH"
        fields = element.fieldNames() if pairs else [""]
        of = lambda x, k: x.getField(k) if pairs else x
        new = [Entry(f.alias, n, i, element[k].dataType if pairs else element) for n, i, k in zip(f.columns, ids, fields)]
        base = [F.col(e.id) for e in left.entries]

        def exploded(df: DataFrame, how) -> Scope:
            df = df.select(*base, how(temp).alias(temp))
            df = df.select(*base, *[of(F.col(temp), k).alias(i) for i, k in zip(ids, fields)])
            return Scope(df, [*left.entries, *new])

        if join.on is None:
            return exploded(made, F.explode_outer if keep_left else F.explode)
        inner = exploded(made, F.explode)
        test = Lowering(self, replace(inner, outer=outer), ctes)
        on = test.resolve(join.on)
        cond = as_bool(test.val(on))
        if not keep_left:
            return Scope(inner.df.where(cond), inner.entries)

        # ON belongs to the join: filter each row's array first, then keep rows whose array is empty.
        def passes(x: Column) -> Column:
            known = {N.Name(i, LOCAL): Val(of(x, k), e.type) for i, k, e in zip(ids, fields, new)}
            return F.coalesce(as_bool(Lowering(self, replace(inner, outer=outer), ctes, known, test.types).val(on)), F.lit(False))

        return exploded(made.withColumn(temp, F.filter(F.col(temp), passes)), F.explode_outer)

    @staticmethod
    def json_pairs(v: Val) -> Column:
        """An array of (key, value) of an object, or (index, value) of an array."""
        pair = lambda k, x: F.struct(k.alias("a"), x.alias("b"))
        if v.is_array:
            return F.transform(v.col, lambda x, i: pair(i, x))
        if isinstance(v.type, T.StructType):
            parts = [pair(F.lit(f.name), as_text(Val(v.col.getField(f.name), f.dataType))) for f in v.type.fields]
            return F.when(v.col.isNotNull(), F.array(*parts))
        if isinstance(v.type, T.MapType):
            return F.transform(F.map_entries(v.col), lambda x: pair(x["key"], as_text(Val(x["value"], v.type.valueType))))
        if v.is_null:
            return F.array().cast("array<struct<a:string,b:string>>")
        if not v.is_text:
            return F.when(v.col.isNotNull(), F.raise_error(F.lit("JSON_EACH takes an object or an array")).cast("array<struct<a:string,b:string>>"))
        kind = F.schema_of_variant(F.parse_json(v.col))  # raises on text that isn't JSON
        items = F.from_json(v.col, "array<string>")
        pairs = F.map_entries(F.from_json(v.col, "map<string,string>"))
        return (
            F.when(kind.startswith("ARRAY"), F.transform(items, lambda x, i: pair(i.cast("string"), x)))
            .when(kind.startswith("OBJECT"), F.transform(pairs, lambda x: pair(x["key"], x["value"])))
            .when(v.col.isNotNull(), F.raise_error(F.lit("JSON_EACH takes an object or an array")).cast("array<struct<a:string,b:string>>"))
        )

    def source(self, node: N.Select, ctes: dict, outer: Scope | None) -> Scope:
        if node.source is None:
            return self.single_row()
        scope = self.relation(node.source, ctes, outer)
        for j in node.joins:
            if j.kind.startswith("lateral"):
                scope = self.lateral(scope, j, ctes, outer)
                continue
            right = self.relation(j.right, ctes, outer)
            entries = [*scope.entries, *right.entries]
            if j.kind == "positional":
                scope = Scope(positional_join(scope.df, right.df, self.fresh()), entries)
                continue
            if j.using:
                cond = None
                for name in j.using:
                    a, b = scope.find(name, None), right.find(name, None)
                    if not a or not b:
                        raise ColumnNotFoundError(f"Column {name!r} in USING is not on both sides", j.start, j.end)
                    c = compare("=", Val(F.col(a.id), a.type), Val(F.col(b.id), b.type))
                    cond = c if cond is None else cond & c
            else:
                both = Scope(scope.df, entries, outer)
                low = Lowering(self, both, ctes)
                cond = as_bool(low.val(low.resolve(j.on)))
            scope = Scope(scope.df.join(right.df, cond, j.kind), entries)
        return scope

    # -- queries --

    def query(self, node: N.Node, ctes: dict, outer: Scope | None) -> tuple[DataFrame, list[Entry]]:
        if isinstance(node, N.With):
            inner = dict(ctes)
            for name, query in node.tables:
                inner[name.lower()] = (query, dict(inner))
            return self.query(node.query, inner, outer)
        if isinstance(node, N.SetOp):
            return self.set_op(node, ctes, outer)
        return self.select(node, ctes, outer)

    def set_op(self, node: N.SetOp, ctes: dict, outer: Scope | None) -> tuple[DataFrame, list[Entry]]:
        left, a = self.query(node.left, ctes, outer)
        right, b = self.query(node.right, ctes, outer)
        if [e.name for e in a] != [e.name for e in b]:
            raise PlanError(f"{node.op} takes sides of equal column names, not ({', '.join(e.name for e in a)}) and ({', '.join(e.name for e in b)})", node.start, node.end)
        left, right = left.select([e.id for e in a]), right.select([e.id for e in b])
        if node.op == "UNION":
            df = left.union(right)
            df = df if node.keep_all else df.distinct()
        elif node.op == "INTERSECT":
            df = left.intersectAll(right) if node.keep_all else left.intersect(right)
        else:
            df = left.exceptAll(right) if node.keep_all else left.subtract(right)
        scope = self.rename(df, [e.name for e in a], None)
        low = Lowering(self, scope, ctes)
        order = tuple(replace(o, expr=low.resolve(self.position(o.expr, [N.Name(e.id, LOCAL) for e in scope.entries], "ORDER BY"))) for o in node.order)
        df = scope.df.orderBy(*low.sort_keys(order)) if order else scope.df
        return self.limited(df, node), scope.entries

    @staticmethod
    def limited(df: DataFrame, node) -> DataFrame:
        if node.offset:
            df = df.offset(node.offset)
        return df if node.limit is None else df.limit(node.limit)

    @staticmethod
    def position(e: N.Node, items: list, clause: str) -> N.Node:
        """The item that a whole number names."""
        if isinstance(e, N.Literal) and isinstance(e.value, int) and not isinstance(e.value, bool):
            if not 1 <= e.value <= len(items):
                raise ParseError(f"{clause} position {e.value} is out of range", e.start, e.end)
            if isinstance(items[e.value - 1], N.Star):
                raise ParseError(f"{clause} position {e.value} points at *", e.start, e.end)
            return items[e.value - 1]
        return e

    @staticmethod
    def substituted(e: N.Node, aliases: dict[str, N.Node]) -> N.Node:
        return N.rewrite(e, lambda n: aliases[n.name] if isinstance(n, N.Name) and n.prefix is None and n.name in aliases else None) if aliases else e

    def select(self, node: N.Select, ctes: dict, outer: Scope | None) -> tuple[DataFrame, list[Entry]]:
        scope = replace(self.source(node, ctes, outer), outer=outer)
        low = Lowering(self, scope, ctes)
        if node.where is not None:
            for part in conjuncts(low.resolve(node.where)):
                df = self.not_in(low, part) if outer is None and isinstance(part, N.Unary) and part.op == "NOT" and isinstance(part.arg, N.InQuery) else None
                scope = replace(scope, df=df if df is not None else scope.df.where(as_bool(low.val(part))))
                low = replace(low, scope=scope)

        # An alias shadows a column in later items, GROUP BY and ORDER BY.
        aliases: dict[str, N.Node] = {}
        items: list[tuple[N.Node, str | None]] = []
        for i in node.items:
            if isinstance(i.expr, N.Star):
                items.append((i.expr, None))
                continue
            e = low.resolve(self.substituted(i.expr, aliases))
            items.append((e, i.alias or derived_alias(i.expr)))
            if i.alias:
                aliases[i.alias] = e
        written = [e for e, _ in items]
        group = [low.resolve(self.substituted(self.position(g, written, "GROUP BY"), aliases)) for g in node.group]
        order = tuple(replace(o, expr=low.resolve(self.substituted(self.position(o.expr, written, "ORDER BY"), aliases))) for o in node.order)
        having = low.resolve(self.substituted(node.having, {k: v for k, v in aliases.items() if not scope.find(k, None)})) if node.having is not None else None

        calls = find_aggregates([*written, *(o.expr for o in order)])
        windows = find_windows([*written, *(o.expr for o in order)])
        if having is not None and not group and not calls:
            raise PlanError("HAVING needs GROUP BY or an aggregate", node.having.start, node.having.end)
        if windows and (group or calls):
            raise PlanError("Window functions can't be mixed with aggregation", windows[0].start, windows[0].end)
        if find_windows([o.expr for o in node.order]) or having is not None and find_windows(having):
            raise PlanError("Window functions are only allowed in SELECT", node.start, node.end)
        if group or calls:
            low = self.grouped(low, group, [*written, having, *(o.expr for o in order)])
            if having is not None:
                low = replace(low, scope=replace(low.scope, df=low.scope.df.where(as_bool(low.val(having)))))
        elif windows:
            name = self.fresh()
            plain = any(w.name == "ROW_NUMBER" and not w.partition and not w.order for w in windows)
            df = with_ordinal(low.scope.df, name) if plain else low.scope.df.withColumn(name, F.monotonically_increasing_id())
            low = replace(low, scope=replace(low.scope, df=df), ordinal=name)
            low, df = self.over_all_rows(low, windows)
            # Windows come before the sort, or their own sorting would undo it.
            values = {w: low.val(w) for w in dict.fromkeys(windows)}
            ids = {w: self.fresh() for w in values}
            df = df.select("*", *[v.col.alias(ids[w]) for w, v in values.items()])
            hidden = [Entry(None, LOCAL + i, i, values[w].type) for w, i in ids.items()]
            stars = low.scope.entries
            low = replace(low, scope=Scope(df, [*stars, *hidden], outer), known={w: Val(F.col(i), values[w].type) for w, i in ids.items()})
            low.stars = stars
        return self.projected(low, node, items, order)

    def percentile_of_all(self, low: Lowering, call: N.Call) -> Column:
        """MEDIAN and its like without groups, from counts per value instead of one buffer of all values."""
        args = [low.val(a) for a in call.args]
        fraction = {"MEDIAN": lambda: 0.5, "PERCENTILE_CONT": lambda: args[0].literal[0], "APPROX_QUANTILE": lambda: args[1].literal[0]}[call.name]()
        value = aggregates.numeric(args[1] if call.name == "PERCENTILE_CONT" else args[0])
        if call.where is not None:
            value = F.when(as_bool(low.val(call.where)), value)
        name = self.fresh()
        return exact_percentile(low.scope.df.select(value.cast("double").alias(name)), name, fraction).scalar()

    def over_all_rows(self, low: Lowering, windows: list) -> tuple[Lowering, DataFrame]:
        """Windows that order all rows without PARTITION BY: by positions, not by a window in one task.

        Rows are sorted by ranges and numbered by counts per range; LAG and LEAD
        by a fixed number of rows join each position with the one they look at.
        """
        df, places, moved = low.scope.df, {}, {}
        for w in dict.fromkeys(windows):
            step = w.args[1] if len(w.args) > 1 else N.Literal(1)
            step = step.value if isinstance(step, N.Literal) and isinstance(step.value, int) else None
            if w.partition or not w.order or w.name != "ROW_NUMBER" and step is None:
                continue
            if w.order not in places:
                places[w.order] = self.fresh()
                df = with_ordinal(df.orderBy(*low.sort_keys(w.order), low.ordinal), places[w.order])
            place = F.col(places[w.order])
            if w.name == "ROW_NUMBER":
                moved[w] = place + 1, None
                continue
            value, at = self.fresh(), self.fresh()
            looked = df.select((place + (step if w.name == "LAG" else -step)).alias(at), low.column(w.args[0]).alias(value))
            df = df.join(looked, place == F.col(at), "left")
            moved[w] = F.col(value), F.col(at)
        return replace(low, scope=replace(low.scope, df=df), moved=moved), df

    def not_in(self, low: Lowering, e: N.Unary) -> DataFrame | None:
        """The rows whose value the subquery doesn't hold, by an anti join that Spark may shuffle.

        Spark's own NOT IN broadcasts the subquery, however large.  Its rule for
        nulls needs two counts only: a null in the subquery leaves no row, and a
        null value stays only where the subquery is empty.  None if the subquery
        takes names from outside.
        """
        df, out = self.query(e.arg.query, low.ctes, replace(low.scope, df=low.scope.df))
        if len(out) != 1:
            raise PlanError("IN takes a subquery of one column", e.start, e.end)
        try:
            df.schema  # noqa: B018  fails on names from outside
        except AnalysisException:
            return None
        a, b = low.val(e.arg.arg), Val(F.col(out[0].id), out[0].type)
        key, other, flag = self.fresh(), self.fresh(), self.fresh()
        if a.is_text == b.is_text and a.is_time == b.is_time:
            left, right = a.col, b.col
        else:
            left, right = (f(v) for f, v in zip([as_time if a.is_time or b.is_time else as_double if a.is_number or b.is_number else as_text] * 2, (a, b)))
        found = df.select(right.alias(other))
        counts = found.agg(F.count(F.lit(1)).alias("n"), F.count(other).alias("k")).select(F.when(F.col("n") == 0, 0).when(F.col("k") < F.col("n"), 2).otherwise(1).alias(flag))
        rows = low.scope.df.withColumn(key, left).join(found.where(F.col(other).isNotNull()), F.col(key) == F.col(other), "left_anti")
        state = counts.scalar()  # 0: empty, 1: no null, 2: a null among them
        return rows.where((state == 0) | (state == 1) & F.col(key).isNotNull()).drop(key)

    def grouped(self, low: Lowering, group: list[N.Node], used: list) -> Lowering:
        """Aggregates, then a lowering in which keys, aggregates and first values are known."""
        calls = list(dict.fromkeys(find_aggregates([u for u in used if u is not None])))
        keys = list(dict.fromkeys(group))
        firsts: dict[N.Name, None] = {}

        def free(n) -> None:
            if n in keys or isinstance(n, N.Call) and n.name in AGGREGATES:
                return
            if isinstance(n, N.Name) and n.prefix == LOCAL:
                firsts.setdefault(n)
            if isinstance(n, N.Star):
                for e in low.scope.entries:
                    if n.prefix in (None, e.qualifier):
                        free(N.Name(e.id, LOCAL))
            if isinstance(n, (N.Scalar, N.Exists, N.InQuery)):  # what a subquery takes from outside
                for x in N.walk(n.query, True):
                    if isinstance(x, N.Name) and x.prefix and (e := low.scope.find(x.name, x.prefix)):
                        free(N.Name(e.id, LOCAL))
            for c in N.children(n):
                if not isinstance(c, (N.Select, N.SetOp, N.With)):
                    free(c)

        for u in used:
            if u is not None:
                free(u)
        ordered = any(c.name in ("ARRAY_AGG", "LIST", "JSON_ARRAYAGG", "STRING_AGG", "MIN_BY", "MAX_BY", "ARG_MIN", "ARG_MAX") for c in calls)
        if ordered or firsts and low.scope.outer is None:
            name = self.fresh()
            low = replace(low, scope=replace(low.scope, df=low.scope.df.withColumn(name, F.monotonically_increasing_id())), ordinal=name)
        key_ids = {k: self.fresh() for k in keys}
        # The group's first row by input order, whatever order a shuffle brings rows in; within a struct nulls count too.
        first = lambda n: F.min_by(F.struct(F.col(n.name).alias("v")), F.col(low.ordinal)).getField("v") if low.ordinal else F.first(F.col(n.name))
        made = [low.aggregate(c) for c in calls] + [first(n) for n in firsts]
        ids = [self.fresh() for _ in made]
        columns = [c.alias(i) for c, i in zip(made, ids)]
        key_columns = [low.column(k).alias(i) for k, i in key_ids.items()]
        source = low.scope.df
        if keys:
            df = source.groupBy(*key_columns).agg(*columns) if columns else source.select(*key_columns).distinct()
        else:
            exact = [self.percentile_of_all(low, c).alias(i) if low.scope.outer is None and c.name in PERCENTILES else x for c, x, i in zip([*calls, *[N.Call("", ())] * len(firsts)], columns, ids)]
            # unlike agg(), select() waits for outer names; the count makes it an aggregate whatever else is in it
            df = source.select(*exact, F.count(F.lit(1)).alias(self.fresh()))
        probe = replace(low, probing=True, types=dict(low.types))
        shown = [probe.column(k).alias(i) for k, i in key_ids.items()] + [c.alias(i) for c, i in zip([probe.aggregate(c) for c in calls] + made[len(calls) :], ids)]
        frame = low.scope.typing(self.spark, *([low.ordinal] if low.ordinal else []))
        n_keys = len(key_ids)
        empty = (frame.groupBy(*shown[:n_keys]).agg(*shown[n_keys:]) if columns else frame.select(*shown)) if keys else frame.agg(*shown)
        types = {f.name: f.dataType for f in empty.schema.fields}
        known = {n: Val(F.col(i), types[i]) for n, i in [*key_ids.items(), *zip([*calls, *firsts], ids)]}
        entries = []
        for e in low.scope.entries:
            v = known.get(N.Name(e.id, LOCAL))
            if v is not None:
                new = key_ids.get(N.Name(e.id, LOCAL)) or ids[len(calls) + list(firsts).index(N.Name(e.id, LOCAL))]
                entries.append(replace(e, id=new))
        known |= {N.Name(e.id, LOCAL): Val(F.col(e.id), e.type) for e in entries}
        shown_ids = {e.id for e in entries}
        entries += [Entry(None, LOCAL + i, i, types[i]) for i in types if i not in shown_ids]  # for the analyzer only: no name finds them
        out = Lowering(self, Scope(df, entries, low.scope.outer), low.ctes, known)
        out.stars = [e for e in low.scope.entries]  # the source's columns, for SELECT *
        return out

    def projected(self, low: Lowering, node: N.Select, items: list, order: tuple) -> tuple[DataFrame, list[Entry]]:
        scope = low.scope
        columns: list[tuple[str, Val, N.Node]] = []
        for e, name in items:
            if isinstance(e, N.Star):
                if node.source is None:
                    raise ParseError("SELECT * needs FROM", e.start, e.end)
                entries = getattr(low, "stars", scope.entries)
                mine = [x for x in entries if e.prefix in (None, x.qualifier)]
                if e.prefix is not None and not mine:
                    raise TableNotFoundError(f"Table {e.prefix!r} not found", e.start, e.end)
                columns += [(x.name, low.val(N.Name(x.id, LOCAL)), N.Name(x.id, LOCAL)) for x in mine]
            else:
                columns.append((name, low.val(e), e))
        last = {name: k for k, (name, _, _) in enumerate(columns)}  # of equal names the last one counts
        first_place = list(dict.fromkeys(name for name, _, _ in columns))
        columns = [columns[last[name]] for name in first_place]
        ids = [self.fresh() for _ in columns]
        made = [v.col.alias(i) for (_, v, _), i in zip(columns, ids)]
        entries = [Entry(None, name, i, v.type) for (name, v, _), i in zip(columns, ids)]
        if not node.distinct:
            df = scope.df
            if order and (scope.outer is not None or low.known):
                df = df.orderBy(*low.sort_keys(order))
            elif order:  # rows that tie keep their input order
                tie = self.fresh()
                df = df.withColumn(tie, F.monotonically_increasing_id()).orderBy(*low.sort_keys(order), tie)
            # The limit comes right upon the sort: Spark ranks a correlated subquery's rows by a sort below its limit only.
            df = self.limited(df, node).select(*made)
        else:
            shown = {e: i for (_, _, e), i in zip(columns, ids)}
            if all(o.expr in shown for o in order):
                df = scope.df.select(*made).distinct()
                if order:
                    after = Lowering(self, Scope(df, entries), low.ctes)
                    df = df.orderBy(*after.sort_keys(tuple(replace(o, expr=N.Name(shown[o.expr], LOCAL)) for o in order)))
            else:
                df = self.distinct_by_hidden(low, made, ids, order)
            df = self.limited(df, node).select(*ids)
        return df, entries

    def distinct_by_hidden(self, low: Lowering, made: list[Column], ids: list[str], order: tuple) -> DataFrame:
        """Distinct rows in the order of the first of their equals: rank by the sort keys, then take the least rank."""
        hidden = [self.fresh() for _ in order]
        df = low.scope.df.select(*made, *[low.column(o.expr).alias(h) for o, h in zip(order, hidden)])
        keys = []
        for o, h in zip(order, hidden):
            c = F.col(h)
            keys.append((c.desc_nulls_last() if o.nulls_last else c.desc_nulls_first()) if o.descending else (c.asc_nulls_last() if o.nulls_last else c.asc_nulls_first()))
        nth = self.fresh()
        ranked = df.withColumn(nth, F.row_number().over(W.partitionBy(*ids).orderBy(*keys)))
        return ranked.where(F.col(nth) == 1).orderBy(*keys)


def conjuncts(e: N.Node) -> list[N.Node]:
    """The conditions that AND joins, in order."""
    return [*conjuncts(e.left), *conjuncts(e.right)] if isinstance(e, N.Binary) and e.op == "AND" else [e]


def first_row(query: N.Node) -> N.Node:
    """The query cut to its first row."""
    if isinstance(query, N.With):
        return replace(query, query=first_row(query.query))
    return replace(query, limit=1 if query.limit is None else min(1, query.limit))


def compile_query(spark: SparkSession, node: N.Node, tables: dict[str, DataFrame], functions: dict | None = None) -> DataFrame:
    df, out = Compiler(spark, tables, functions).query(node, {}, None)
    return df.select([F.col(e.id).alias(e.name) for e in out])
