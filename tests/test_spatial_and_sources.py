import json
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from veinstone import Engine
from veinstone.plans.catalogue import QUERIES
from veinstone.sources.tables import custom_source, from_batches, to_batches
from veinstone.spatial import geometry as G
from veinstone.streaming.windows import Cancellable, rows, tumbling


def shape(wkt):
    return G.shape(G.wkt_to_geojson(wkt))


SQUARE, INNER, BESIDE = "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", "POLYGON ((1 1, 2 1, 2 2, 1 2, 1 1))", "POLYGON ((4 0, 6 0, 6 4, 4 4, 4 0))"
HOLED = "POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (3 3, 6 3, 6 6, 3 6, 3 3))"


@pytest.mark.parametrize(
    "relation, a, b, want",
    [
        (G.intersects, SQUARE, BESIDE, True), (G.intersects, SQUARE, "POINT (5 5)", False), (G.intersects, HOLED, "POINT (4 4)", False),
        (G.covers, SQUARE, INNER, True), (G.covers, INNER, SQUARE, False), (G.covers, SQUARE, "POINT (4 4)", True), (G.covers, HOLED, "POLYGON ((2 2, 7 2, 7 7, 2 7, 2 2))", False),
        (G.covers, HOLED, "LINESTRING (1 4, 8 4)", False), (G.contains_properly, SQUARE, INNER, True), (G.contains_properly, SQUARE, "POINT (4 4)", False),
        (G.touches, SQUARE, BESIDE, True), (G.touches, SQUARE, INNER, False), (G.touches, "LINESTRING (0 0, 1 1)", "LINESTRING (1 1, 2 0)", True),
        (G.overlaps, SQUARE, "POLYGON ((2 2, 6 2, 6 6, 2 6, 2 2))", True), (G.overlaps, SQUARE, INNER, False), (G.overlaps, "LINESTRING (0 0, 2 0)", "LINESTRING (1 0, 3 0)", True),
        (G.crosses, "LINESTRING (0 0, 2 2)", "LINESTRING (0 2, 2 0)", True), (G.crosses, "LINESTRING (-1 1, 5 1)", SQUARE, True), (G.crosses, "LINESTRING (1 1, 2 2)", SQUARE, False),
        (G.equals, SQUARE, "POLYGON ((4 4, 4 0, 0 0, 0 4, 4 4))", True), (G.equals, SQUARE, INNER, False), (G.equals, "MULTIPOINT (1 1, 2 2)", "MULTIPOINT ((2 2), (1 1))", True),
    ],
)
def test_relations(relation, a, b, want):
    assert relation(shape(a), shape(b)) is want


def test_distance():
    assert G.within_distance(shape("POINT (0 0)"), shape("POINT (3 4)"), 5) and not G.within_distance(shape("POINT (0 0)"), shape("POINT (3 4)"), 4.9)
    assert not G.within_distance(shape("POINT (0 0)"), shape("POINT (0 0)"), -1)
    assert G.distance(shape(SQUARE), shape("LINESTRING (6 0, 6 4)")) == 2


def test_distance_has_no_slack():
    for n, cents in [(5, 400000), (5, 400001), (5, 399999), (15, 400003), (15, 399997), (6, 700000), (7, 0), (10, 900000), (10, 900001)]:
        y = cents / 100 / 1000
        assert G.within_distance(shape(f"POINT ({n} {y})"), shape("POINT (10 4)"), 5) is (math.sqrt((n - 10) * (n - 10) + (y - 4) * (y - 4)) <= 5)
    assert G.within_distance(shape("POINT (4 9)"), shape(SQUARE), 5) and not G.within_distance(shape("POINT (4 9.00000000005)"), shape(SQUARE), 5)
    assert G.within_distance(shape("POINT (-0.0000001 0)"), shape("POINT (10000000000 0)"), 1e10)
    draw = random.Random(1)
    for _ in range(500):
        a, b = (draw.uniform(-9, 9), draw.uniform(-9, 9)), (draw.uniform(-9, 9), draw.uniform(-9, 9))
        d = math.sqrt((a[0] - b[0]) * (a[0] - b[0]) + (a[1] - b[1]) * (a[1] - b[1]))
        assert G.within_distance(G.Shape([a]), G.Shape([b]), d) and not G.within_distance(G.Shape([a]), G.Shape([b]), math.nextafter(d, 0))


def test_st_dwithin_at_the_edge(spark):
    """The registered query on balances whose points lie within 1e-10 of the circle."""
    rows = [(i, n, c / 100) for i, (n, c) in enumerate((n, c) for n in (5, 15) for c in range(399990, 400011))]
    text, sql = QUERIES["st_dwithin"]
    df = spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_acctbal double")
    con = duckdb.connect()
    con.sql("CREATE TABLE customer (c_custkey BIGINT, c_nationkey INTEGER, c_acctbal DOUBLE)")
    con.executemany("INSERT INTO customer VALUES (?, ?, ?)", rows)
    got = sorted(r[0] for r in Engine(spark, {"customer": df}).sql(text).collect())
    assert got == sorted(r[0] for r in con.sql(sql).fetchall()) and len(got) == 2


@pytest.mark.parametrize("wkt", [SQUARE, HOLED, "POINT (1 -2.5)", "LINESTRING (0 0, 1 1)", "MULTIPOINT (0 0, 1 1)", "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)))"])
def test_wkt_round_trip(wkt):
    assert G.geojson_to_wkt(G.wkt_to_geojson(wkt)) == wkt


@pytest.mark.parametrize("wkt", ["", "POINT", "POINT (1)", "POINT (a b)", "CIRCLE (1 1)", "POLYGON (0 0, 1 1)", None])
def test_bad_wkt(wkt):
    assert G.wkt_to_geojson(wkt) is None


def test_bad_geojson():
    assert G.shape("{") is None and G.shape(json.dumps({"type": "Point"})) is None and G.shape(None) is None


def test_custom_source(spark):
    def scan(hints):
        for i in range(hints["part"], 10, hints["parts"]):
            yield (i, f"n{i}")

    source = custom_source("tens", "id long, name string", scan, 2)
    spark.dataSource.register(source)
    df = spark.read.format("tens").load()
    assert df.where("id > 6").count() == 3
    batches = list(to_batches(df.orderBy("id"), 4))
    assert list(from_batches(batches)) == [{"id": i, "name": f"n{i}"} for i in range(10)]
    assert [b.num_rows for b in batches] == [4, 4, 2] and batches[0].column(1)[0].as_py() == "n0"


def test_tumbling_bounded_and_streaming(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    n = events.count()
    counted = tumbling(events, "ts", "1 day", [F.count(F.lit(1)).alias("n")], ["event_type"])
    assert sum(r["n"] for r in rows(counted)) == n
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = tumbling(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "ts", "1 day", [F.count(F.lit(1)).alias("n")], ["event_type"])
    q = stream.writeStream.outputMode("complete").format("memory").queryName("tumbled").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("tumbled").agg(F.sum("n")).first()[0] == n


def test_a_running_query_is_cancelled(spark):
    import threading
    import time

    ended = []

    def work():
        try:
            with Cancellable(spark, "endless"):
                spark.range(10**13).selectExpr("sum(id % 7)").collect()
        except Exception as e:  # noqa: BLE001
            ended.append(e)

    thread = threading.Thread(target=work)
    thread.start()
    for _ in range(60):
        time.sleep(0.5)
        Cancellable(spark, "endless").cancel()
        if not thread.is_alive():
            break
    thread.join(10)
    assert not thread.is_alive() and ended
