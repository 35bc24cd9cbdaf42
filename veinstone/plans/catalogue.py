"""The engine's registered queries and their oracle SQL.

Each entry is a query in the engine's dialect and the equivalent for DuckDB.
Where the dialects agree the second is None and the same text serves both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veinstone.api import Engine
from veinstone.sources.tables import parquet_tables
from veinstone.sql.visitors import extract_tables

SHIP = "TIMESTAMP '1998-09-02 00:00:00'"
QUERIES: dict[str, tuple[str, str | None]] = {
    # scans, projection, predicates
    "scan_project": ("SELECT c_custkey, c_name, c_acctbal FROM customer", None),
    "scan_count": ("SELECT COUNT(*) AS n FROM lineitem", None),
    "from_first": ("FROM nation", "SELECT * FROM nation"),
    "select_no_from": ("SELECT 1 AS one, 'x' AS x", None),
    "star_qualified": ("SELECT n.*, n.n_nationkey * 2 AS twice FROM nation n", "SELECT n.*, (n.n_nationkey * 2)::BIGINT AS twice FROM nation n"),
    "filter_compare": ("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 45 AND l_discount < 0.03 OR l_tax = 0.08", None),
    "filter_3vl_not": ("SELECT c_custkey FROM customer WHERE NOT (NULLIF(c_nationkey, 3) > 10)", None),
    "between": ("SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000 AND o_orderkey NOT BETWEEN 10 AND 100", None),
    "in_list": ("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')", None),
    "not_in_list": ("SELECT n_name FROM nation WHERE n_regionkey NOT IN (1, 2)", None),
    "like_ci": ("SELECT p_partkey FROM part WHERE p_type LIKE '%brass%' OR p_name LIKE '_art%'", "SELECT p_partkey FROM part WHERE p_type ILIKE '%brass%' OR p_name ILIKE '_art%'"),
    "is_null": ("SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL", None),
    "is_not_null": ("SELECT COUNT(*) AS n FROM events WHERE value IS NOT NULL", None),
    "case_searched": ("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders", None),
    "case_simple": ("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders", None),
    "alias_shadow": ("SELECT n_nationkey + 1 AS n_nationkey, n_nationkey * 2 AS twice FROM nation", "SELECT (n_nationkey + 1)::BIGINT AS n_nationkey, ((n_nationkey + 1) * 2)::BIGINT AS twice FROM nation"),
    "implicit_alias": ("SELECT c_acctbal * 2 doubled, c_custkey \"the key\" FROM customer", None),
    "arithmetic": ("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) + l_tax AS a, l_quantity / 7 AS b, -l_tax AS c, l_linenumber % 3 AS d FROM lineitem", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) + l_tax AS a, l_quantity / 7 AS b, -l_tax AS c, (l_linenumber % 3)::BIGINT AS d FROM lineitem"),
    "division_by_zero": ("SELECT c_custkey, c_acctbal / (c_nationkey - 3) AS q, c_custkey % (c_nationkey - 3) AS r FROM customer", "SELECT c_custkey, c_acctbal / NULLIF(c_nationkey - 3, 0) AS q, c_custkey % NULLIF(c_nationkey - 3, 0) AS r FROM customer"),
    "loose_compare": ("SELECT c_custkey FROM customer WHERE CAST(c_custkey AS STRING) = 17 OR c_name = 5", "SELECT c_custkey FROM customer WHERE c_custkey = 17"),
    "truthiness": ("SELECT n_name FROM nation WHERE n_regionkey", "SELECT n_name FROM nation WHERE n_regionkey <> 0"),
    "cast": ("SELECT p_partkey, CAST(p_retailprice AS INT) AS i, CAST(p_size AS STRING) AS s, CAST(p_size AS DOUBLE) AS d, CAST('1.7' AS INT) AS t, TRY_CAST(p_name AS INT) AS n, CAST(p_size AS BOOLEAN) AS b FROM part", "SELECT p_partkey, trunc(p_retailprice)::BIGINT AS i, p_size::VARCHAR AS s, p_size::DOUBLE AS d, 1::BIGINT AS t, NULL::BIGINT AS n, p_size <> 0 AS b FROM part"),
    "concat_operator": ("SELECT c_custkey, c_name || '/' || c_mktsegment || c_custkey AS label FROM customer", None),
    "subscript": ("SELECT vec_id, embedding[0] AS first, embedding[999] AS none FROM embeddings", "SELECT vec_id, embedding[1] AS first, embedding[1000] AS none FROM embeddings"),
    # aggregation
    "pricing_summary": (f"SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS sum_qty, AVG(l_extendedprice) AS avg_price, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= {SHIP} GROUP BY l_returnflag, l_linestatus ORDER BY 1, 2", f"SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS sum_qty, AVG(l_extendedprice) AS avg_price, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= {SHIP} GROUP BY ALL"),
    "scalar_agg": ("SELECT COUNT(*) AS n, SUM(l_linenumber) AS s, MIN(l_shipdate) AS low, MAX(l_quantity) AS high FROM lineitem", "SELECT COUNT(*) AS n, SUM(l_linenumber)::BIGINT AS s, MIN(l_shipdate) AS low, MAX(l_quantity) AS high FROM lineitem"),
    "group_having": ("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12 AND MAX(o_totalprice) > 1000", None),
    "group_alias": ("SELECT UPPER(o_orderpriority) AS pri, COUNT(*) AS n FROM orders GROUP BY pri", "SELECT UPPER(o_orderpriority) AS pri, COUNT(*) AS n FROM orders GROUP BY 1"),
    "group_position": ("SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY 1", None),
    "group_expression": ("SELECT p_size % 5 AS k, MAX(p_partkey) AS top FROM part GROUP BY p_size % 5", "SELECT (p_size % 5)::BIGINT AS k, MAX(p_partkey) AS top FROM part GROUP BY ALL"),
    "agg_filter": ("SELECT l_returnflag, COUNT(*) FILTER (WHERE l_quantity > 25) AS big, MAX(l_orderkey) FILTER (WHERE l_tax = 0) AS untaxed FROM lineitem GROUP BY l_returnflag", None),
    "count_distinct": ("SELECT COUNT(DISTINCT l_partkey) AS parts, COUNT(DISTINCT l_returnflag) AS flags FROM lineitem", None),
    "countif": ("SELECT o_orderstatus, COUNTIF(o_totalprice > 100000) AS n FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, COUNT(*) FILTER (WHERE o_totalprice > 100000) AS n FROM orders GROUP BY ALL"),
    "min_by_max_by": ("SELECT c_nationkey, MIN_BY(c_custkey, c_acctbal) AS poor, ARG_MAX(c_custkey, c_acctbal) AS rich FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, arg_min(c_custkey, c_acctbal) AS poor, arg_max(c_custkey, c_acctbal) AS rich FROM customer GROUP BY ALL"),
    "any_value": ("SELECT n_regionkey, ANY_VALUE(n_regionkey * 10) AS v FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, (n_regionkey * 10)::BIGINT AS v FROM nation GROUP BY ALL"),
    "first_row_rule": ("SELECT r_regionkey, r_name, COUNT(*) AS n FROM region GROUP BY r_regionkey", "SELECT r_regionkey, r_name, COUNT(*) AS n FROM region GROUP BY ALL"),
    "stddev": ("SELECT c_nationkey, ROUND(STDDEV_SAMP(c_acctbal), 4) AS s, ROUND(STDDEV_POP(c_acctbal), 4) AS p FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, floor(stddev_samp(c_acctbal) * 10000 + 0.5) / 10000 AS s, floor(stddev_pop(c_acctbal) * 10000 + 0.5) / 10000 AS p FROM customer GROUP BY ALL"),
    "median_percentile": ("SELECT c_mktsegment, MEDIAN(c_acctbal) AS m, PERCENTILE_CONT(0.25, c_acctbal) AS q1, PERCENTILE_CONT(0.75) WITHIN GROUP (ORDER BY c_acctbal) AS q3 FROM customer GROUP BY c_mktsegment", "SELECT c_mktsegment, median(c_acctbal) AS m, quantile_cont(c_acctbal, 0.25) AS q1, quantile_cont(c_acctbal, 0.75) AS q3 FROM customer GROUP BY ALL"),
    "approx_quantile": ("SELECT APPROX_QUANTILE(l_quantity, 0.9) AS q FROM lineitem", "SELECT quantile_cont(l_quantity, 0.9) AS q FROM lineitem"),
    "array_agg_sorted": ("SELECT n_regionkey, ARRAY_SORT(ARRAY_AGG(n_name)) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, list_sort(list(n_name)) AS names FROM nation GROUP BY ALL"),
    "array_agg_nulls": ("SELECT n_regionkey, ARRAY_LENGTH(ARRAY_AGG(NULLIF(n_nationkey, 5))) AS n FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, count(*)::INT AS n FROM nation GROUP BY ALL"),
    "string_agg": ("SELECT n_regionkey, STRING_AGG(n_name, '; ') AS names FROM (SELECT * FROM nation ORDER BY n_nationkey) n GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_nationkey) AS names FROM nation GROUP BY ALL"),
    "order_by_hidden_agg": ("SELECT c_mktsegment FROM customer GROUP BY c_mktsegment ORDER BY SUM(c_acctbal) DESC LIMIT 2", "SELECT c_mktsegment FROM customer GROUP BY c_mktsegment ORDER BY SUM(c_acctbal) DESC LIMIT 2"),
    "sum_text": ("SELECT SUM(json_value(props, '$.k')) AS s, AVG(event_type) AS none FROM events", "SELECT SUM((props->>'$.k')::DOUBLE) AS s, NULL::DOUBLE AS none FROM events"),
    # joins
    "join_inner": ("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey", None),
    "join_left": ("SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 200000", None),
    "join_right": ("SELECT o.o_orderkey, c.c_custkey FROM orders o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey", None),
    "join_full": ("SELECT d.doc_id, l.quality FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id AND l.quality = 1", None),
    "join_theta": ("SELECT s.s_suppkey, n.n_nationkey FROM supplier s JOIN nation n ON s.s_nationkey > n.n_nationkey + 18", None),
    "join_residual": ("SELECT COUNT(*) AS n FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey AND l.l_extendedprice > o.o_totalprice / 4", None),
    "join_using": ("SELECT l.quality, d.lang FROM documents d JOIN labels l USING (doc_id)", None),
    "join_self": ("SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None),
    "join_three_way": ("SELECT c.c_name, n.n_name, r.r_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey", None),
    "join_subquery": ("SELECT c.c_name, t.total FROM customer c JOIN (SELECT o_custkey, COUNT(*) AS total FROM orders GROUP BY o_custkey) t ON t.o_custkey = c.c_custkey", None),
    "join_star_duplicates": ("SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey", None),
    "join_positional": ("SELECT a.n_name AS x, b.r_name AS y FROM (SELECT * FROM nation ORDER BY n_nationkey) a POSITIONAL JOIN (SELECT * FROM region ORDER BY r_regionkey) b", "SELECT a.n_name AS x, b.r_name AS y FROM nation a POSITIONAL JOIN region b"),
    # subqueries
    "semi_exists": ("SELECT c.c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)", None),
    "anti_not_exists": ("SELECT c.c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)", None),
    "in_subquery": ("SELECT COUNT(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 5)", None),
    "not_in_subquery": ("SELECT d.doc_id FROM documents d WHERE d.doc_id NOT IN (SELECT l.doc_id FROM labels l)", None),
    "scalar_subquery": ("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) * 1.5 FROM orders)", None),
    "correlated_scalar": ("SELECT c.c_custkey, (SELECT MAX(o.o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS top FROM customer c", None),
    "correlated_top1": ("SELECT c.c_custkey, (SELECT o.o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o.o_totalprice DESC, o.o_orderkey LIMIT 1) AS best FROM customer c", None),
    "subquery_in_or": ("SELECT c.c_custkey FROM customer c WHERE c.c_acctbal > 9000 OR c.c_custkey IN (SELECT o.o_custkey FROM orders o WHERE o.o_totalprice > 280000)", None),
    "cte_chain": ("WITH spend AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey), top AS (SELECT MAX(n) AS n FROM spend) SELECT s.o_custkey, s.n FROM spend s JOIN top t ON s.n = t.n", None),
    "derived_table": ("SELECT band, COUNT(*) AS n FROM (SELECT CASE WHEN p_size > 25 THEN 'L' ELSE 'S' END AS band FROM part) x GROUP BY band", None),
    # set operations
    "union_all": ("SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey AS k FROM region", None),
    "union_distinct": ("SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey AS k FROM region", None),
    "intersect": ("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier", None),
    "intersect_all": ("SELECT n_regionkey AS k FROM nation INTERSECT ALL SELECT r_regionkey AS k FROM region", None),
    "except": ("SELECT n_nationkey AS k FROM nation EXCEPT SELECT r_regionkey AS k FROM region", None),
    "except_all": ("SELECT n_regionkey AS k FROM nation EXCEPT ALL SELECT r_regionkey AS k FROM region", None),
    "setop_precedence": ("SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 3 UNION SELECT n_nationkey AS k FROM nation INTERSECT SELECT r_regionkey AS k FROM region ORDER BY k DESC LIMIT 4", None),
    # windows
    "row_number": ("SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders", None),
    "row_number_all": ("SELECT COUNT(*) AS n, MAX(rn) AS top, SUM(rn) AS s FROM (SELECT ROW_NUMBER() OVER () AS rn FROM orders) t", "SELECT COUNT(*) AS n, MAX(rn) AS top, SUM(rn)::BIGINT AS s FROM (SELECT ROW_NUMBER() OVER () AS rn FROM orders) t"),
    "lag_default": ("SELECT event_id, LAG(value, 1, 0) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events", "SELECT event_id, LAG(value, 1, 0.0) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events"),
    "lead_offset": ("SELECT event_id, LEAD(event_type, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS later FROM events", None),
    "window_in_expr": ("SELECT event_id, value - LAG(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events", None),
    "topn_per_group": ("SELECT c_custkey, c_nationkey FROM (SELECT c_custkey, c_nationkey, ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) t WHERE rn <= 3", None),
    # order, limit, distinct
    "topk": ("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10", None),
    "order_nulls": ("SELECT n_nationkey FROM nation ORDER BY NULLIF(n_regionkey, 2) DESC, n_nationkey LIMIT 8", "SELECT n_nationkey FROM nation ORDER BY NULLIF(n_regionkey, 2) DESC NULLS FIRST, n_nationkey LIMIT 8"),
    "order_nulls_last": ("SELECT n_nationkey FROM nation ORDER BY NULLIF(n_regionkey, 0) NULLS LAST, n_nationkey LIMIT 8", None),
    "order_alias": ("SELECT p_partkey, p_size * p_retailprice AS w FROM part ORDER BY w DESC, p_partkey LIMIT 5", None),
    "limit_offset": ("SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 7 OFFSET 5", None),
    "distinct": ("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", None),
    "distinct_hidden_order": ("SELECT DISTINCT n_regionkey FROM nation ORDER BY n_nationkey DESC LIMIT 3", "SELECT n_regionkey FROM nation GROUP BY n_regionkey ORDER BY max(n_nationkey) DESC LIMIT 3"),
    # scalar libraries
    "str_basic": ("SELECT c_custkey, UPPER(c_name) AS u, LOWER(c_mktsegment) AS l, LENGTH(c_name) AS n, OCTET_LENGTH(c_name) AS o, TRIM('  ' || c_name || ' ') AS t, REPLACE(c_name, '#', '-') AS r, CONCAT(c_name, ':', c_nationkey) AS c FROM customer", "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, length(c_name)::INT AS n, strlen(c_name)::INT AS o, c_name AS t, replace(c_name, '#', '-') AS r, concat(c_name, ':', c_nationkey) AS c FROM customer"),
    "str_parts": ("SELECT p_partkey, SUBSTRING(p_type, 2, 4) AS a, SUBSTR(p_type, 3) AS b, LEFT(p_type, 3) AS c, RIGHT(p_type, 3) AS d, INSTR(p_type, 'A') AS e, POSITION('S' IN p_type) AS f, STRPOS(p_type, 'zz') AS g FROM part", "SELECT p_partkey, substring(p_type, 2, 4) AS a, substr(p_type, 3) AS b, left(p_type, 3) AS c, right(p_type, 3) AS d, instr(p_type, 'A')::INT AS e, instr(p_type, 'S')::INT AS f, instr(p_type, 'zz')::INT AS g FROM part"),
    "str_split": ("SELECT p_partkey, SPLIT_PART(p_brand, '#', 2) AS a, SPLIT_PART(p_type, ' ', -1) AS b, ARRAY_LENGTH(STRING_SPLIT(p_type, ' ')) AS n FROM part", "SELECT p_partkey, split_part(p_brand, '#', 2) AS a, split_part(p_type, ' ', -1) AS b, len(string_split(p_type, ' '))::INT AS n FROM part"),
    "regex": ("SELECT doc_id, REGEXP_SUBSTR(text, '[0-9]+') AS first, REGEXP_EXTRACT(text, '[0-9]+', 1, 2) AS second, REGEXP_MATCHES(text, '[0-9]{16}') AS card FROM documents", "SELECT doc_id, list_extract(regexp_extract_all(text, '[0-9]+'), 1) AS first, list_extract(regexp_extract_all(text, '[0-9]+'), 2) AS second, regexp_matches(text, '[0-9]{16}') AS card FROM documents"),
    "regex_replace": ("SELECT p_partkey, REGEXP_REPLACE(p_type, '[AEIOU]', '*') AS a, REGEXP_REPLACE(p_type, '[AEIOU]', '*', 4) AS b FROM part", "SELECT p_partkey, regexp_replace(p_type, '[AEIOU]', '*', 'g') AS a, left(p_type, 3) || regexp_replace(substr(p_type, 4), '[AEIOU]', '*', 'g') AS b FROM part"),
    "regex_replace_nth": ("SELECT p_partkey, REGEXP_REPLACE(p_type, ' ', '_', 1, 2) AS a FROM part", "SELECT p_partkey, CASE WHEN len(string_split(p_type, ' ')) > 2 THEN split_part(p_type, ' ', 1) || ' ' || split_part(p_type, ' ', 2) || '_' || array_to_string(string_split(p_type, ' ')[3:], ' ') ELSE p_type END AS a FROM part"),
    "math_basic": ("SELECT c_custkey, FLOOR(c_acctbal) AS f, CEIL(c_acctbal) AS c, ROUND(c_acctbal) AS r, ROUND(c_acctbal, 1) AS r1, ABS(c_acctbal) AS a, SIGN(c_acctbal) AS s, MOD(c_custkey, 7) AS m FROM customer", "SELECT c_custkey, floor(c_acctbal) AS f, ceil(c_acctbal) AS c, floor(c_acctbal + 0.5) AS r, floor(c_acctbal * 10.0::DOUBLE + 0.5) / 10.0::DOUBLE AS r1, abs(c_acctbal) AS a, sign(c_acctbal)::DOUBLE AS s, (c_custkey % 7)::DOUBLE AS m FROM customer"),
    "math_powers": ("SELECT p_partkey, ROUND(SQRT(p_size), 6) AS s, ROUND(EXP(p_size / 50), 6) AS e, ROUND(LN(p_size), 6) AS l, ROUND(LOG10(p_size), 6) AS g, POWER(p_size, 2) AS p FROM part", "SELECT p_partkey, floor(sqrt(p_size) * 1000000 + 0.5) / 1000000 AS s, floor(exp(p_size / 50) * 1000000 + 0.5) / 1000000 AS e, floor(ln(p_size) * 1000000 + 0.5) / 1000000 AS l, floor(log10(p_size) * 1000000 + 0.5) / 1000000 AS g, power(p_size, 2)::DOUBLE AS p FROM part"),
    "trig": ("SELECT p_partkey, ROUND(SIN(p_size), 6) AS s, ROUND(COS(p_size), 6) AS c, ROUND(TAN(p_size), 5) AS t, ROUND(COT(p_size), 5) AS ct, ROUND(ATAN(p_size), 6) AS a, ROUND(ATAN2(p_size, 3), 6) AS a2, ROUND(ASIN(p_size / 100), 6) AS sn, ROUND(ACOS(p_size / 100), 6) AS cs, ROUND(DEGREES(p_size), 4) AS d, ROUND(RADIANS(p_size), 6) AS r, ROUND(PI(), 6) AS pi FROM part", "SELECT p_partkey, floor(sin(p_size) * 1e6 + 0.5) / 1e6 AS s, floor(cos(p_size) * 1e6 + 0.5) / 1e6 AS c, floor(tan(p_size) * 1e5 + 0.5) / 1e5 AS t, floor(cot(p_size) * 1e5 + 0.5) / 1e5 AS ct, floor(atan(p_size) * 1e6 + 0.5) / 1e6 AS a, floor(atan2(p_size, 3) * 1e6 + 0.5) / 1e6 AS a2, floor(asin(p_size / 100) * 1e6 + 0.5) / 1e6 AS sn, floor(acos(p_size / 100) * 1e6 + 0.5) / 1e6 AS cs, floor(degrees(p_size) * 1e4 + 0.5) / 1e4 AS d, floor(radians(p_size) * 1e6 + 0.5) / 1e6 AS r, 3.141593::DOUBLE AS pi FROM part"),
    "date_trunc": ("SELECT o_orderkey, DATE_TRUNC('month', o_orderdate) AS m, DATE_TRUNC('year', o_orderdate) AS y FROM orders", "SELECT o_orderkey, date_trunc('month', o_orderdate)::TIMESTAMP AS m, date_trunc('year', o_orderdate)::TIMESTAMP AS y FROM orders"),
    "date_part": ("SELECT event_id, EXTRACT(YEAR FROM ts) AS y, EXTRACT(MONTH FROM ts) AS mo, DATE_PART('day', ts) AS d, EXTRACT(HOUR FROM ts) AS h, EXTRACT(DOW FROM ts) AS w, EPOCH(ts) AS e FROM events", "SELECT event_id, year(ts)::INT AS y, month(ts)::INT AS mo, day(ts)::INT AS d, hour(ts)::INT AS h, dayofweek(ts)::INT AS w, epoch(ts) AS e FROM events"),
    "date_diff": ("SELECT o_orderkey, DATE_DIFF('day', TIMESTAMP '1992-01-01 00:00:00', o_orderdate) AS d, DATE_DIFF('month', TIMESTAMP '1992-01-31 00:00:00', o_orderdate) AS m, DATEDIFF('year', o_orderdate, TIMESTAMP '2000-01-01 00:00:00') AS y FROM orders", "SELECT o_orderkey, date_sub('day', TIMESTAMP '1992-01-01', o_orderdate) AS d, date_diff('month', TIMESTAMP '1992-01-31', o_orderdate)::INT AS m, date_diff('year', o_orderdate, TIMESTAMP '2000-01-01')::INT AS y FROM orders"),
    "interval_add": ("SELECT event_id, ts + INTERVAL 3 HOUR AS a, ts - INTERVAL '2' DAY AS b FROM events", "SELECT event_id, ts + INTERVAL 3 HOUR AS a, ts - INTERVAL 2 DAY AS b FROM events"),
    "date_text": ("SELECT '2024-02-28' + INTERVAL 2 DAY AS a, DATE_TRUNC('month', '2024-05-17') AS b, DATE_TRUNC('hour', '2024-05-17T10:20:30Z') AS c", "SELECT '2024-03-01' AS a, '2024-05-01' AS b, '2024-05-17T10:00:00.000Z' AS c"),
    "json_extract": ("SELECT event_id, JSON_VALUE(props, '$.k') AS k, JSON_EXTRACT_STRING(props, 'k') AS s, JSON_VALID(props) AS ok, JSON_TYPE(props) AS t, JSON_KEYS(props) AS ks FROM events", "SELECT event_id, props->>'$.k' AS k, props->>'$.k' AS s, json_valid(props) AS ok, lower(json_type(props)) AS t, json_keys(props) AS ks FROM events"),
    "json_filter": ("SELECT event_id FROM events WHERE JSON_VALUE(props, '$.k') > 50", "SELECT event_id FROM events WHERE (props->>'$.k')::DOUBLE > 50"),
    "array_functions": ("SELECT vec_id, ARRAY_LENGTH(embedding) AS n, LEN(embedding) AS l, ARRAY_CONTAINS([1, 2, 3], label) AS c, ARRAY_POSITION([5, 6, 7], label) AS p FROM embeddings", "SELECT vec_id, len(embedding)::INT AS n, len(embedding)::INT AS l, list_contains([1, 2, 3], label) AS c, NULLIF(list_position([5, 6, 7], label), 0)::BIGINT AS p FROM embeddings"),
    "conditional": ("SELECT c_custkey, COALESCE(NULLIF(c_nationkey, 3), -1) AS c, GREATEST(c_nationkey, 10) AS g, LEAST(c_nationkey, 10) AS l FROM customer", None),
    # table functions
    "unnest_lateral": ("SELECT e.vec_id, u.x FROM embeddings e CROSS JOIN UNNEST(e.embedding) AS u(x) WHERE u.x > 0.3", "SELECT vec_id, x FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) WHERE x > 0.3"),
    "unnest_outer": ("SELECT d.doc_id, w FROM documents d LEFT JOIN UNNEST(STRING_SPLIT(d.text, ' ')) AS u(w) ON w LIKE '%@%'", "SELECT d.doc_id, u.w FROM documents d LEFT JOIN (SELECT * FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) WHERE w LIKE '%@%') u ON u.doc_id = d.doc_id"),
    "unnest_from": ("SELECT x FROM UNNEST([3, 1, 2]) AS u(x)", "SELECT unnest([3, 1, 2]) AS x"),
    "lateral_view": ("SELECT doc_id, COUNT(*) AS n FROM documents LATERAL VIEW EXPLODE(STRING_SPLIT(text, ' ')) t AS w GROUP BY doc_id", "SELECT doc_id, len(string_split(text, ' ')) AS n FROM documents"),
    "json_each": ("SELECT e.event_id, j.key, j.value FROM events e JOIN JSON_EACH(e.props) AS j ON TRUE", "SELECT e.event_id, j.key, j.value::VARCHAR AS value FROM events e, json_each(e.props) j"),
    "string_split_unnest": ("SELECT w, COUNT(*) AS n FROM documents JOIN UNNEST(STRING_SPLIT(LOWER(text), ' ')) AS u(w) ON TRUE WHERE lang = 'en' GROUP BY w HAVING COUNT(*) > 20", "SELECT w, COUNT(*) AS n FROM (SELECT unnest(string_split(lower(text), ' ')) AS w FROM documents WHERE lang = 'en') GROUP BY w HAVING COUNT(*) > 20"),
    "exists_unnest": ("SELECT e.vec_id FROM embeddings e WHERE EXISTS (SELECT 1 FROM UNNEST(e.embedding) AS u(x) WHERE x > 0.35)", "SELECT vec_id FROM embeddings WHERE list_max(embedding) > 0.35"),
    # spatial: points made of numeric columns
    "st_dwithin": ("SELECT c_custkey FROM customer WHERE ST_DWITHIN(ST_GEOMFROMTEXT(CONCAT('POINT(', c_nationkey, ' ', c_acctbal / 1000, ')')), ST_GEOMFROMTEXT('POINT(10 4)'), 5)", "SELECT c_custkey FROM customer WHERE sqrt((c_nationkey - 10) * (c_nationkey - 10) + (c_acctbal / 1000 - 4) * (c_acctbal / 1000 - 4)) <= 5"),
    "st_contains": ("SELECT s_suppkey FROM supplier WHERE ST_CONTAINS(ST_MAKEENVELOPE(2, 0, 12, 5), ST_GEOMFROMTEXT(CONCAT('POINT(', s_nationkey, ' ', s_acctbal / 1000, ')')))", "SELECT s_suppkey FROM supplier WHERE s_nationkey BETWEEN 2 AND 12 AND s_acctbal / 1000 BETWEEN 0 AND 5"),
    "st_intersects": ("SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE ST_INTERSECTS(ST_MAKEENVELOPE(a.n_nationkey, 0, a.n_nationkey + 2, 1), ST_MAKEENVELOPE(b.n_nationkey, 1, b.n_nationkey + 2, 2))", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE abs(a.n_nationkey - b.n_nationkey) <= 2"),
    "st_astext": ("SELECT r_regionkey, ST_ASTEXT(ST_GEOMFROMTEXT(CONCAT('POINT(', r_regionkey, ' 1.5)'))) AS w FROM region", "SELECT r_regionkey, 'POINT (' || r_regionkey || ' 1.5)' AS w FROM region"),
    "st_relations": ("SELECT ST_TOUCHES(ST_MAKEENVELOPE(0,0,1,1), ST_MAKEENVELOPE(1,0,2,1)) AS t, ST_OVERLAPS(ST_MAKEENVELOPE(0,0,2,2), ST_MAKEENVELOPE(1,1,3,3)) AS o, ST_CROSSES(ST_GEOMFROMTEXT('LINESTRING(0 0, 2 2)'), ST_GEOMFROMTEXT('LINESTRING(0 2, 2 0)')) AS c, ST_EQUALS(ST_MAKEENVELOPE(0,0,1,1), ST_GEOMFROMTEXT('POLYGON((1 1, 0 1, 0 0, 1 0, 1 1))')) AS e, ST_WITHIN(ST_GEOMFROMTEXT('POINT(1 1)'), ST_MAKEENVELOPE(0,0,1,1)) AS w, ST_CONTAINSPROPERLY(ST_MAKEENVELOPE(0,0,1,1), ST_GEOMFROMTEXT('POINT(1 1)')) AS p, ST_COVERS(ST_MAKEENVELOPE(0,0,1,1), ST_GEOMFROMTEXT('POINT(1 1)')) AS v, ST_COVEREDBY(ST_GEOMFROMTEXT('POINT(3 1)'), ST_MAKEENVELOPE(0,0,1,1)) AS b", "SELECT TRUE AS t, TRUE AS o, TRUE AS c, TRUE AS e, TRUE AS w, FALSE AS p, TRUE AS v, FALSE AS b"),
    # more of the above
    "round_large": ("SELECT c_custkey, ROUND(c_acctbal * 1e16) AS r, FLOOR(c_acctbal * 1e16) AS f, CEIL(c_acctbal * -1e16) AS c, ROUND(c_acctbal * 1e9, 8) AS d FROM customer WHERE c_acctbal > 1000", "SELECT c_custkey, c_acctbal * 1e16 AS r, c_acctbal * 1e16 AS f, c_acctbal * -1e16 AS c, c_acctbal * 1e9 AS d FROM customer WHERE c_acctbal > 1000"),
    "first_row_many": ("SELECT o_custkey, o_orderkey, o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_custkey", "SELECT o_custkey, first(o_orderkey ORDER BY file_row_number) AS o_orderkey, first(o_orderstatus ORDER BY file_row_number) AS o_orderstatus, COUNT(*) AS n FROM (SELECT *, row_number() OVER () AS file_row_number FROM orders) GROUP BY o_custkey"),
    "group_star": ("SELECT *, COUNT(*) AS n FROM nation GROUP BY n_regionkey", "SELECT first(n_nationkey ORDER BY k) AS n_nationkey, first(n_name ORDER BY k) AS n_name, n_regionkey, COUNT(*) AS n FROM (SELECT *, row_number() OVER () AS k FROM nation) GROUP BY n_regionkey"),
    "stable_ties": ("SELECT n_nationkey, ROW_NUMBER() OVER () AS rn FROM (SELECT n_nationkey FROM nation ORDER BY n_regionkey) t", "SELECT n_nationkey, row_number() OVER (ORDER BY n_regionkey, k) AS rn FROM (SELECT *, row_number() OVER () AS k FROM nation)"),
    "json_object": ("SELECT r_regionkey, JSON_EXTRACT_STRING(JSON_OBJECT('name', r_name, 'key', r_regionkey), 'name') AS s, JSON_TYPE(JSON_OBJECT('k', r_regionkey)) AS t FROM region", "SELECT r_regionkey, json_object('name', r_name, 'key', r_regionkey)->>'name' AS s, 'object' AS t FROM region"),
    "json_array_length": ("SELECT event_id, JSON_ARRAY_LENGTH('[1, 2, {}]') AS n, JSON_ARRAY_LENGTH(CONCAT('[', event_id, ',', user_id, ']')) AS m FROM events", "SELECT event_id, 3 AS n, 2 AS m FROM events"),
    "array_append_concat": ("SELECT n_nationkey, ARRAY_APPEND([1, 2], n_nationkey) AS a, ARRAY_CONCAT(STRING_SPLIT(n_name, '_'), ['x', 'y']) AS c FROM nation", "SELECT n_nationkey, list_append([1, 2], n_nationkey)::BIGINT[] AS a, list_concat(string_split(n_name, '_'), ['x', 'y']) AS c FROM nation"),
    "struct_dot": ("SELECT t.o.k AS k, t.o.name AS name FROM (SELECT JSON_OBJECT('k', n_nationkey, 'name', n_name) AS o FROM nation) t", "SELECT n_nationkey AS k, n_name AS name FROM nation"),
    "unnest_view_outer": ("SELECT n_nationkey, x FROM nation LATERAL VIEW OUTER EXPLODE(STRING_SPLIT(NULLIF(n_name, 'NATION_3'), '_')) t AS x", "SELECT n_nationkey, unnest(CASE WHEN n_name = 'NATION_3' THEN [NULL] ELSE string_split(n_name, '_') END) AS x FROM nation"),
    "join_theta_left": ("SELECT s.s_suppkey, n.n_nationkey FROM supplier s LEFT JOIN nation n ON s.s_nationkey > n.n_nationkey + 18", None),
    "join_theta_right": ("SELECT s.s_suppkey, n.n_nationkey FROM supplier s RIGHT JOIN nation n ON s.s_nationkey > n.n_nationkey + 18", None),
    "join_theta_full": ("SELECT r.r_regionkey, n.n_nationkey FROM region r FULL JOIN nation n ON r.r_regionkey > n.n_nationkey + 1", None),
    "agg_distinct": ("SELECT n_regionkey, SUM(DISTINCT n_regionkey) AS s, AVG(DISTINCT n_nationkey % 3) AS a, COUNT(DISTINCT n_name) AS c FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, SUM(DISTINCT n_regionkey)::BIGINT AS s, AVG(DISTINCT n_nationkey % 3) AS a, COUNT(DISTINCT n_name) AS c FROM nation GROUP BY n_regionkey"),
    "lag_varying": ("SELECT n_nationkey, LAG(n_name, n_nationkey % 3) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS b FROM nation", "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN n_name WHEN 1 THEN lag(n_name, 1) OVER w ELSE lag(n_name, 2) OVER w END AS b FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)"),
    "window_no_partition": ("SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rn, LAG(o_orderkey) OVER (ORDER BY o_totalprice DESC, o_orderkey) AS before, LEAD(o_orderkey, 2, -1) OVER (ORDER BY o_orderkey) AS later FROM orders", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rn, lag(o_orderkey) OVER (ORDER BY o_totalprice DESC, o_orderkey) AS before, lead(o_orderkey, 2, -1) OVER (ORDER BY o_orderkey) AS later FROM orders"),
    "not_in_nulls": ("SELECT n_nationkey FROM nation WHERE NULLIF(n_regionkey, 2) NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey > 3) AND n_nationkey NOT IN (SELECT NULLIF(r_regionkey, 0) FROM region WHERE r_regionkey > 0)", None),
    "median_all": ("SELECT MEDIAN(l_extendedprice) AS m, PERCENTILE_CONT(0.9, l_quantity) AS q, COUNT(*) AS n FROM lineitem", "SELECT median(l_extendedprice) AS m, quantile_cont(l_quantity, 0.9) AS q, COUNT(*) AS n FROM lineitem"),
    "st_multi": ("SELECT s_suppkey FROM supplier WHERE ST_INTERSECTS(ST_GEOMFROMTEXT('MULTIPOINT((1 1), (5 2), (30 3))'), ST_MAKEENVELOPE(s_nationkey - 1, 0, s_nationkey + 1, 4))", "SELECT s_suppkey FROM supplier WHERE 1 BETWEEN s_nationkey - 1 AND s_nationkey + 1 OR 5 BETWEEN s_nationkey - 1 AND s_nationkey + 1 OR 30 BETWEEN s_nationkey - 1 AND s_nationkey + 1"),
    # user functions
    "udf_no_argument": ("SELECT n_nationkey, HELLO() AS h, WAITED() AS w FROM nation", "SELECT n_nationkey, 'hello' AS h, 'waited' AS w FROM nation"),
    "udf_scalar": ("SELECT c_custkey, SHOUT(c_name) AS s FROM customer", "SELECT c_custkey, upper(c_name) || '!' AS s FROM customer"),
    "udf_async": ("SELECT n_nationkey, LATER(n_name) AS s FROM nation", "SELECT n_nationkey, reverse(n_name) AS s FROM nation"),
}


async def _later(text):
    return None if text is None else text[::-1]


async def _waited():
    return "waited"


FUNCTIONS = {"HELLO": {"apply": lambda: "hello", "arguments": {"min": 0, "max": 0}}, "WAITED": {"apply": _waited, "arguments": {"min": 0, "max": 0}}, "SHOUT": {"apply": lambda s: None if s is None else s.upper() + "!", "arguments": {"min": 1, "max": 1}}, "LATER": {"apply": _later, "arguments": {"min": 1, "max": 1}}}


def _query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark, functions=FUNCTIONS)
        node = engine.parse(text)
        for name, df in parquet_tables(spark, sf_dir, extract_tables(node)).items():
            engine.register(name, df)
        return engine.sql(node)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _query(q) for k, (q, _) in QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: o or q for k, (q, o) in QUERIES.items()}


__all__ = ["QUERIES", "oracles", "queries"]
