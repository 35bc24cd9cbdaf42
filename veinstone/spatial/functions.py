"""The ST_ functions.  A geometry is a struct with one GeoJSON text, or a GeoJSON-shaped struct column."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veinstone.functions.scalars import scalar
from veinstone.functions.types import Val, as_double
from veinstone.spatial import geometry as G

GEOMETRY = T.StructType([T.StructField("geojson", T.StringType())])


def geojson(v: Val) -> Column:
    """The GeoJSON text of a geometry; null for anything else, WKT text too."""
    if isinstance(v.type, T.StructType):
        names = v.type.fieldNames()
        if names == ["geojson"]:
            return v.col.getField("geojson")
        if "type" in names and ("coordinates" in names or "geometries" in names):
            return F.to_json(v.col)
    if isinstance(v.type, T.VariantType):
        return F.to_json(v.col)
    return F.lit(None).cast("string")


def _relation(test):
    """An Arrow-batched boolean function of two GeoJSON texts; null if either isn't a geometry."""

    @F.pandas_udf("boolean")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            s, t = G.shape(x), G.shape(y)
            out.append(None if s is None or t is None else test(s, t))
        return pd.Series(out, dtype=object)

    return run


RELATIONS = {
    "ST_INTERSECTS": G.intersects,
    "ST_CONTAINS": G.covers,
    "ST_CONTAINSPROPERLY": G.contains_properly,
    "ST_WITHIN": lambda a, b: G.covers(b, a),
    "ST_OVERLAPS": G.overlaps,
    "ST_TOUCHES": G.touches,
    "ST_EQUALS": G.equals,
    "ST_CROSSES": G.crosses,
    "ST_COVERS": G.covers,
    "ST_COVEREDBY": lambda a, b: G.covers(b, a),
}


def _register(name: str, test) -> None:
    @scalar(name, low=2, text="geometry, geometry")
    def build(a):
        return _relation(test)(geojson(a[0]), geojson(a[1]))


for _name, _test in RELATIONS.items():
    _register(_name, _test)


@scalar("ST_DWITHIN", low=3, text="geometry, geometry, distance")
def dwithin(a):
    @F.pandas_udf("boolean")
    def run(x: pd.Series, y: pd.Series, d: pd.Series) -> pd.Series:
        out = []
        for p, q, r in zip(x, y, d):
            s, t = G.shape(p), G.shape(q)
            out.append(None if s is None or t is None or pd.isna(r) else G.within_distance(s, t, r))
        return pd.Series(out, dtype=object)

    return run(geojson(a[0]), geojson(a[1]), as_double(a[2]))


@scalar("ST_GEOMFROMTEXT", text="wkt")
def geom_from_text(a):
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(G.wkt_to_geojson, na_action="ignore").astype(object)

    if not a[0].is_text:
        return F.lit(None).cast(GEOMETRY)
    made = run(a[0].col)
    return F.when(made.isNotNull(), F.struct(made.alias("geojson")))


@scalar("ST_MAKEENVELOPE", low=4, text="xmin, ymin, xmax, ymax")
def make_envelope(a):
    x1, y1, x2, y2 = map(as_double, a)
    ring = F.array(F.array(x1, y1), F.array(x2, y1), F.array(x2, y2), F.array(x1, y2), F.array(x1, y1))
    some = x1.isNotNull() & y1.isNotNull() & x2.isNotNull() & y2.isNotNull()
    return F.when(some, F.struct(F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))).alias("geojson")))


@scalar("ST_ASTEXT", text="geometry")
def as_wkt(a):
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(G.geojson_to_wkt, na_action="ignore").astype(object)

    return run(geojson(a[0]))
