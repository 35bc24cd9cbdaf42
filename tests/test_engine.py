import math

import pytest

from veinstone import Engine, collect
from veinstone.sql.errors import ArgumentError, ColumnNotFoundError, PlanError, TableNotFoundError


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    e.register("people", [dict(id=1, name="Ann", age=31, town="Oslo"), dict(id=2, name="Bob", age=None, town="Rome"), dict(id=3, name="Cid", age=44, town="Oslo")])
    e.register("buys", [dict(id=1, who=1, sum=5.5), dict(id=2, who=1, sum=2.0), dict(id=3, who=9, sum=1.0)])
    e.register("lists", spark.createDataFrame([(1, [1, 2]), (2, []), (3, None)], "id int, arr array<int>"))
    e.register("docs", spark.createDataFrame([(1, '{"a": 1, "b": {"c": [1, 2]}}'), (2, "[5, 6]"), (3, None)], "id int, js string"))
    e.register("nested", spark.createDataFrame([(1, ("x", [("t", 2)]))], "id int, s struct<f:string,l:array<struct<n:string,v:int>>>"))
    e.register("dotted", spark.createDataFrame([(1, "v")], ["id", "user.name"]))
    e.register("nothing", spark.createDataFrame([], "id int, name string"))
    return e


def one(engine, text):
    return collect(engine.sql(text))[0]


def rows(engine, text):
    return [tuple(r.values()) for r in collect(engine.sql(text))]


def test_traps_of_expressions(engine):
    r = one(engine, "SELECT 7 / 0 AS a, 7 % 0 AS b, MOD(7, 0) AS c, '10' = 10 AS d, 'abc' = 0 AS e, NOT ('abc' = 0) AS f, 'aXb' LIKE 'AX_' AS g, 'a\\b' LIKE 'a\\b' AS h, CAST('1.7' AS INT) AS i, CAST('false' AS BOOLEAN) AS j, 'n' || 1.0 AS k, ROUND(-2.5) AS l, CASE NULL WHEN NULL THEN 1 END AS m")
    assert math.isnan(r.pop("c"))
    assert r == dict(a=None, b=None, d=True, e=False, f=True, g=True, h=True, i=1, j=True, k="n1", l=-2.0, m=1)


def test_nulls_first_both_ways(engine):
    assert rows(engine, "SELECT age FROM people ORDER BY age") == [(None,), (31,), (44,)]
    assert rows(engine, "SELECT age FROM people ORDER BY age DESC") == [(None,), (44,), (31,)]
    assert rows(engine, "SELECT age FROM people ORDER BY age DESC NULLS LAST") == [(44,), (31,), (None,)]


def test_alias_shadowing(engine):
    assert rows(engine, "SELECT id + 1 AS id, id * 2 AS b FROM people ORDER BY 1 DESC LIMIT 1") == [(4, 8)]
    assert rows(engine, "SELECT UPPER(town) AS town, COUNT(*) AS n FROM people GROUP BY town ORDER BY town") == [("OSLO", 2), ("ROME", 1)]


def test_duplicate_names_keep_the_last(engine):
    r = collect(engine.sql("SELECT * FROM people p JOIN buys b ON p.id = b.who ORDER BY b.id"))
    assert [x["id"] for x in r] == [1, 2] and list(r[0]) == ["id", "name", "age", "town", "who", "sum"]


def test_aggregates(engine):
    r = one(engine, "SELECT COUNT(*) AS n, COUNT(age) AS k, SUM(age) AS s, ARRAY_AGG(age) AS l, STRING_AGG(name, '+') AS t, MIN_BY(name, age) AS m, SUM(name) AS none, COUNTIF(age > 40) AS c, STDDEV_SAMP(CASE WHEN id = 1 THEN 1 END) AS d FROM people")
    assert r == dict(n=3, k=2, s=75, l=[31, None, 44], t="Ann+Bob+Cid", m="Ann", none=None, c=1, d=None)
    assert one(engine, "SELECT ARRAY_AGG(id) AS l, STRING_AGG(name, ',') AS s, SUM(id) AS t, COUNT(*) AS n FROM nothing") == dict(l=[], s=None, t=None, n=0)


def test_grouping_rules(engine):
    assert rows(engine, "SELECT name, COUNT(*) FROM people") == [("Ann", 3)]
    assert rows(engine, "SELECT town FROM people GROUP BY town HAVING MAX(age) > 40 ORDER BY COUNT(*)") == [("Oslo",)]
    with pytest.raises(PlanError):
        engine.sql("SELECT name FROM people HAVING COUNT(*) > 1")
    with pytest.raises(PlanError):
        engine.sql("SELECT SUM(COUNT(*)) FROM people")


def test_joins(engine):
    assert sorted(rows(engine, "SELECT p.name, b.sum FROM people p LEFT JOIN buys b ON p.id = b.who AND b.sum > 3")) == [("Ann", 5.5), ("Bob", None), ("Cid", None)]
    assert len(rows(engine, "SELECT p.id, b.id AS bid FROM people p FULL JOIN buys b ON p.id = b.who")) == 5
    assert rows(engine, "SELECT a.id AS x, b.sum FROM people a POSITIONAL JOIN buys b ORDER BY x") == [(1, 5.5), (2, 2.0), (3, 1.0)]
    assert rows(engine, "SELECT p.id, n.name FROM people p LEFT JOIN nothing n ON p.id = n.id WHERE p.id = 1") == [(1, None)]


def test_table_functions(engine):
    assert rows(engine, "SELECT id, x FROM lists LEFT JOIN UNNEST(arr) AS u(x) ON x > 1 ORDER BY id") == [(1, 2), (2, None), (3, None)]
    assert rows(engine, "SELECT id, x FROM lists, UNNEST(arr) AS u(x)") == [(1, 1), (1, 2)]
    assert rows(engine, "SELECT id, x FROM lists LATERAL VIEW OUTER EXPLODE(arr) u AS x ORDER BY id, x") == [(1, 1), (1, 2), (2, None), (3, None)]
    assert rows(engine, "SELECT id, key, value FROM docs JOIN JSON_EACH(js) AS j ON TRUE ORDER BY id, key") == [(1, "a", "1"), (1, "b", '{"c":[1,2]}'), (2, "0", "5"), (2, "1", "6")]
    assert rows(engine, "SELECT * FROM UNNEST([3, 4]) AS u(x)") == [(3,), (4,)]
    assert rows(engine, "SELECT * FROM UNNEST(NULL)") == []


def test_subqueries(engine):
    assert rows(engine, "SELECT p.name FROM people p WHERE EXISTS (SELECT 1 FROM buys b WHERE b.who = p.id)") == [("Ann",)]
    assert rows(engine, "SELECT name FROM people WHERE id NOT IN (SELECT who FROM buys) ORDER BY name") == [("Bob",), ("Cid",)]
    assert rows(engine, "SELECT name FROM people WHERE id NOT IN (1, NULL)") == []
    assert rows(engine, "SELECT p.id, (SELECT b.sum FROM buys b WHERE b.who = p.id ORDER BY b.sum LIMIT 1) AS s FROM people p ORDER BY p.id") == [(1, 2.0), (2, None), (3, None)]
    assert rows(engine, "SELECT id FROM lists WHERE EXISTS (SELECT 1 FROM UNNEST(lists.arr) AS u(x) WHERE x > 1)") == [(1,)]
    assert rows(engine, "SELECT (SELECT id FROM people ORDER BY id DESC) AS top") == [(3,)]


def test_windows(engine):
    assert rows(engine, "SELECT id, ROW_NUMBER() OVER () AS r, LAG(name, 1, '-') OVER (ORDER BY id) AS l, LEAD(age) OVER (PARTITION BY town ORDER BY id) AS d FROM people ORDER BY id") == [(1, 1, "-", 44), (2, 2, "Ann", None), (3, 3, "Bob", None)]
    assert rows(engine, "SELECT id, LAG(name, id - 1) OVER (ORDER BY id) AS v FROM people ORDER BY id") == [(1, "Ann"), (2, "Ann"), (3, "Ann")]


def test_set_operations_need_equal_names(engine):
    assert sorted(rows(engine, "SELECT town FROM people UNION SELECT town FROM people")) == [("Oslo",), ("Rome",)]
    with pytest.raises(PlanError):
        engine.sql("SELECT id FROM people UNION SELECT name FROM people")


def test_distinct_with_hidden_order(engine):
    assert rows(engine, "SELECT DISTINCT town FROM people ORDER BY age") == [("Rome",), ("Oslo",)]


def test_text_dates_keep_their_form(engine):
    r = one(engine, "SELECT '2024-01-31' + INTERVAL 1 MONTH AS a, DATE_TRUNC('month', '2024-05-17T08:00:00Z') AS b, DATE_DIFF('month', '2024-01-31', '2024-02-01') AS c, DATE_DIFF('day', '2024-01-01T12:00:00Z', '2024-01-03T00:00:00Z') AS d, EXTRACT(DOW FROM '2024-05-05') AS e, DATE_TRUNC('day', 'junk') AS f")
    assert r == dict(a="2024-03-02", b="2024-05-01T00:00:00.000Z", c=1, d=1, e=0, f=None)


def test_json(engine):
    assert rows(engine, "SELECT JSON_VALUE(js, '$.b.c[1]') AS v, JSON_TYPE(js) AS t, JSON_ARRAY_LENGTH(js) AS n, JSON_VALID(js) AS ok FROM docs ORDER BY id") == [("2", "object", None, True), (None, "array", 2, True), (None, None, None, None)]
    assert one(engine, "SELECT JSON_VALID('{') AS a, JSON_OBJECT('k', 1) AS o") == dict(a=False, o={"k": 1})
    with pytest.raises(Exception):
        collect(engine.sql("SELECT JSON_VALUE('{', '$.a') AS x FROM people"))


def test_structs_arrays_and_dots(engine):
    assert rows(engine, "SELECT s.f, nested.s.l[0].n, s['l'][0]['v'] AS v FROM nested") == [("x", "t", 2)]
    assert rows(engine, "SELECT \"user.name\", user.name AS again FROM dotted") == [("v", "v")]
    assert one(engine, "SELECT ARRAY_POSITION([1, 2], 3) AS a, ARRAY_CONTAINS([1, NULL], 5) AS b, ARRAY_LENGTH([[1], [2, 3]], 2) AS c, ARRAY_SORT([3, NULL, 1]) AS d, [1, 2][5] AS e") == dict(a=None, b=False, c=None, d=[1, 3, None], e=None)


def test_regex_and_strings(engine):
    r = one(engine, "SELECT REGEXP_REPLACE('abcabc', 'b', 'X', 1, 2) AS a, REGEXP_REPLACE('abab', 'b', 'X', 3) AS b, REGEXP_SUBSTR('a1b22', '[0-9]+', 1, 2) AS c, SPLIT_PART('a-b-c', '-', -1) AS d, SPLIT_PART('a', '-', 9) AS e, STRING_SPLIT('a.b', '.') AS f, STRING_SPLIT('ab', '') AS g, POSITION('l' IN 'hello') AS h, TRIM(' \t\nx ') AS i")
    assert r == dict(a="abcaXc", b="abaX", c="22", d="c", e="", f=["a", "b"], g=["ab"], h=3, i="x")


@pytest.mark.parametrize("text, error", [("SELECT nme FROM people", ColumnNotFoundError), ("SELECT * FROM peeple", TableNotFoundError), ("SELECT x.* FROM people p", TableNotFoundError), ("SELECT SUBSTR('a', 0)", ArgumentError), ("SELECT LEFT('a', -1)", ArgumentError), ("SELECT SPLIT_PART('a', 'b', 0)", ArgumentError), ("SELECT PERCENTILE_CONT(2, age) FROM people", ArgumentError), ("SELECT JSON_OBJECT('a')", ArgumentError), ("SELECT *", Exception), ("SELECT id FROM people ORDER BY 4", Exception), ("SELECT Name FROM people", ColumnNotFoundError)])
def test_plan_errors(engine, text, error):
    with pytest.raises(error):
        engine.sql(text)


def test_user_functions(engine, spark):
    async def slow(x):
        return f"<{x}>"

    e = Engine(spark, {"t": [dict(a="x"), dict(a=None)]}, {"Wrap": slow, "ADD": {"apply": lambda a, b: a + b, "returns": "long", "arguments": {"min": 2, "max": 2}}})
    assert sorted(rows(e, "SELECT wrap(a) AS w, add(1, 2) AS s FROM t")) == [("<None>", 3), ("<x>", 3)]
    with pytest.raises(Exception):
        e.sql("SELECT ADD(1) FROM t")


def test_plans(engine, spark):
    e = Engine(spark, {"li": spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet"), "o": spark.read.parquet("/root/testdata/sf0.001/orders.parquet")})
    plan = e.explain("SELECT l_orderkey FROM li WHERE l_quantity > 40 ORDER BY l_extendedprice LIMIT 3")
    assert "TakeOrderedAndProject" in plan and "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,40.0)]" in plan and "l_comment" not in plan
    plan = e.explain("SELECT o.o_orderkey FROM o WHERE EXISTS (SELECT 1 FROM li WHERE li.l_orderkey = o.o_orderkey)")
    assert "LeftSemi" in plan and "Cartesian" not in plan and "BroadcastNestedLoop" not in plan


def test_tables_from_rows(spark):
    with pytest.raises(ValueError):
        Engine(spark, {"t": []})
    with pytest.raises(ValueError):
        Engine(spark, {"t": [dict(a=1), dict(b=2)]})


def test_unnested_structs_and_subquery_arguments(engine, spark):
    engine.register("traces", spark.createDataFrame([(1, [("a", 1), ("b", 2)]), (2, [])], "id int, tools array<struct<name:string,n:int>>"))
    assert sorted(rows(engine, "SELECT id, t.name FROM traces, UNNEST(tools) AS t")) == [(1, "a"), (1, "b")]
    assert rows(engine, "SELECT id, t.name FROM traces JOIN UNNEST(tools) AS t(x) ON t.n > 1") == [(1, "b")]
    assert sorted(rows(engine, "SELECT x FROM UNNEST((SELECT ARRAY_AGG(id) FROM people)) AS u(x)")) == [(1,), (2,), (3,)]


def test_nested_correlation_and_ctes(engine):
    assert rows(engine, "SELECT p.id, (SELECT COUNT(*) FROM buys b WHERE b.who = p.id AND b.sum > (SELECT MIN(sum) FROM buys)) AS c FROM people p ORDER BY p.id") == [(1, 2), (2, 0), (3, 0)]
    assert rows(engine, "WITH People AS (SELECT id FROM people WHERE id > 1) SELECT COUNT(*) AS n FROM PEOPLE a JOIN people b ON a.id = b.id") == [(2,)]


@pytest.mark.parametrize(
    "query, skip",
    [
        ("SELECT id, (SELECT x.id FROM t x WHERE x.k = o.k ORDER BY x.s DESC, x.id LIMIT 1) AS best FROM o", 0),
        ("SELECT id, (SELECT x.id FROM t x WHERE x.k = o.k ORDER BY x.s DESC, x.id LIMIT 9) AS best FROM o", 0),
        ("SELECT id, (SELECT x.id FROM t x WHERE x.k = o.k ORDER BY x.s DESC, x.id) AS best FROM o", 0),
        ("SELECT id, (WITH y AS (SELECT * FROM t) SELECT x.id FROM y x WHERE x.k = o.k ORDER BY x.s DESC, x.id LIMIT 2 OFFSET 3) AS best FROM o", 3),
        ("SELECT id, (SELECT DISTINCT x.id FROM t x WHERE x.k = o.k ORDER BY x.s DESC, x.id LIMIT 1) AS best FROM o", 0),
        ("SELECT o.id, o.id AS best FROM o WHERE o.id IN (SELECT x.k FROM t x WHERE x.k = o.k ORDER BY x.s DESC, x.id LIMIT 1)", None),
    ],
)
def test_first_rows_of_correlated_subqueries_are_ranked(spark, query, skip):
    """Ranked by the sort keys, not by the order in which a shuffle happens to bring rows."""
    import re

    data = [(i, i % 7, i * 37 % 11) for i in range(200)]
    df = Engine(spark, {"t": spark.createDataFrame(data, "id long, k long, s long"), "o": spark.createDataFrame([(i, i) for i in range(9)], "id long, k long")}).sql(query)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    ranks = re.findall(r"row_number\(\) windowspecdefinition\(.*?specifiedwindowframe", plan)
    assert ranks and all(" ASC " in r or " DESC " in r for r in ranks)
    best = {k: [i for i, g, _ in sorted(data, key=lambda r: (-r[2], r[0])) if g == k] for k in range(9)}
    want = [(i, (best[i][skip] if best[i] else None) if skip is not None else i) for i in range(9) if skip is not None or best[i]]
    assert sorted(map(tuple, df.collect())) == want


@pytest.mark.parametrize("text", ["SELECT x FROM lists LATERAL VIEW EXPLODE(arr) AS x", "SELECT x FROM lists LATERAL VIEW EXPLODE(arr) t", "SELECT * FROM UNNEST(arr)", "SELECT * FROM JSON_EACH('{}') AS j(a, b, c)"])
def test_table_function_errors(engine, text):
    with pytest.raises(Exception):
        engine.sql(text)


def test_positions_behind_a_shuffle(engine, spark):
    spark.range(0, 5000).selectExpr("id", "cast(hash(id) as long) as h").repartition(7).createOrReplaceTempView("shuffled")
    e = Engine(spark, {"t": spark.table("shuffled")})
    got = rows(e, "SELECT a.id AS x, b.id AS y FROM (SELECT id FROM t ORDER BY id) a POSITIONAL JOIN (SELECT id FROM t ORDER BY id DESC LIMIT 4000) b")
    assert sorted(got, key=lambda r: r[0]) == [(i, 4999 - i if i < 4000 else None) for i in range(5000)]
    assert rows(e, "SELECT COUNT(DISTINCT r) AS n, MIN(r) AS a, MAX(r) AS b FROM (SELECT ROW_NUMBER() OVER () AS r FROM (SELECT DISTINCT h FROM t) d) q") == [(5000, 1, 5000)] or len({h for _, h in spark.table("shuffled").collect()}) < 5000


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def numbers(spark):
    return Engine(spark, {"t": spark.range(1000).selectExpr("id", "id % 7 as k", "cast(id as string) as s"), "u": spark.range(50).selectExpr("id * 3 as x")})


@pytest.mark.parametrize("query", ["SELECT id, ROW_NUMBER() OVER (ORDER BY k, id) AS rn FROM t", "SELECT id, LAG(id) OVER (ORDER BY id) AS b, LEAD(id, 2, -1) OVER (ORDER BY k, id) AS c FROM t"])
def test_windows_over_all_rows_are_not_one_task(numbers, query):
    import re

    plan = _plan(numbers.sql(query))
    # only the counts per partition meet in one task
    assert not re.search(r"Window \[(row_number|lag|lead)", plan)


def test_not_in_is_an_anti_join(numbers):
    plan = _plan(numbers.sql("SELECT id FROM t WHERE id NOT IN (SELECT x FROM u) AND k > 2"))
    assert "LeftAnti" in plan and "NAAJ" not in plan.upper() and "isNullAwareAntiJoin" not in plan
    assert numbers.sql("SELECT id FROM t WHERE id NOT IN (SELECT x FROM u) AND id < 10").count() == 6
    assert numbers.sql("SELECT id FROM t WHERE id NOT IN (SELECT NULLIF(x, 3) FROM u)").count() == 0
    assert numbers.sql("SELECT id FROM t WHERE NULLIF(id, 1) NOT IN (SELECT x FROM u WHERE x < 0)").count() == 1000
    assert numbers.sql("SELECT a.id FROM t a WHERE a.id NOT IN (SELECT x FROM u WHERE x = a.id)").count() == 950


def test_like_without_inner_marks_needs_no_regular_expression(numbers):
    assert "RLIKE" not in _plan(numbers.sql("SELECT id FROM t WHERE s LIKE '%9%'")).upper()
    for pattern, n in (("%99%", 19), ("99%", 11), ("%99", 10), ("99", 1), ("%", 1000), ("9_", 10)):
        assert numbers.sql(f"SELECT id FROM t WHERE s LIKE '{pattern}'").count() == n


def test_large_numbers_keep_their_value(numbers):
    got = numbers.sql("SELECT FLOOR(1e20) AS a, ROUND(1e20) AS b, ROUND(12345678901234.5, 6) AS c, CEIL(-1e300) AS d, ROUND(2.5) AS e, ROUND(-2.5) AS f").collect()[0]
    assert tuple(got) == (1e20, 1e20, 12345678901234.5, -1e300, 3.0, -2.0)


def test_plan_and_execute(numbers):
    plan = numbers.plan("SELECT COUNT(*) AS n FROM t WHERE k = 1")
    assert plan.columns == ["n"] and numbers.execute(plan) == [{"n": 143}]


def test_functions_without_arguments(numbers):
    async def later():
        return "later"

    numbers.function("NOW_IS", lambda: "now")
    numbers.function("LATER_IS", later)
    got = numbers.sql("SELECT NOW_IS() AS a, LATER_IS() AS b FROM u").collect()
    assert {tuple(r) for r in got} == {("now", "later")} and len(got) == 50


def test_percentiles_of_all_rows_are_not_one_buffer(spark, numbers):
    query = "SELECT MEDIAN(id) AS m, PERCENTILE_CONT(0.9, k) FILTER (WHERE id > 500) AS p, APPROX_QUANTILE(s, 0.25) AS q, COUNT(*) AS n FROM t"
    assert "percentile(" not in _plan(numbers.sql(query))
    want = spark.range(1000).selectExpr("percentile(id, 0.5)", "percentile(CASE WHEN id > 500 THEN id % 7 END, 0.9)", "percentile(id, 0.25)", "count(*)").first()
    assert tuple(numbers.sql(query).first()) == tuple(want)
    assert numbers.sql("SELECT MEDIAN(id) AS m FROM t WHERE id < 0").collect()[0]["m"] is None
    assert len(numbers.sql("SELECT MEDIAN(id) AS m FROM t").collect()) == 1
