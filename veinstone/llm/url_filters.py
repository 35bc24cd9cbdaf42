"""URL filters: a path-template tree with smoothed labelled purity, natively.

1. Host and path are parsed; explicit rules decide first (the longest wins).
2. The urls that a rule decides are the labels.  Equal paths of a host become
   one row with counts; such rows are all that the tree needs, so a hot host
   weighs no more than its distinct paths.
3. Level by level and per host, a segment stays literal if it differs from its
   siblings: its urls are blocked more or less often (a two-proportion test), or
   other segments follow it (a chi-square test of the next segments' counts).
   Branches that differ in neither are statistically similar and merge into `*`;
   numbers, dates and names become variable by that test alone.  An only child
   has no siblings and stays.  Paths that have ended, or are the only one left
   of their branch, need no further level; the tree grows until all are so.
4. A template's share of blocked labels is smoothed towards the same template
   on all hosts, and that towards all labels; at REJECT or more it is blocked.

Null urls and urls without `://` have empty host and path; they form the empty
template.  Ties go to block.  Repeated rows get equal verdicts.  The rows of a
large branch, and the pages of a path that very many share, are joined in parts
of SPLIT, so a hot host is no one task's.  Long paths take as many
levels as they share with others.  Only built-in DataFrame functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.llm.common import join_dealt, materialize, read_table

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
Z = 2.5758  # the normal quantile of 1 %, two-sided
#: Rows of one key (a host's branch, a path's pages) beyond which a join deals them out.
SPLIT = 1024
#: Levels of the oracle's SQL, which can't loop until all paths have ended.
ORACLE_LEVELS = 5
PRIOR = 4.0
REJECT = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def _ordered(rules: list[tuple[str, str]]) -> list[tuple[str, str, str, str]]:
    """(verdict, rule, host, path), longest rule first."""
    split = [(v, r, r.split("/", 1)[0], "/" + r.split("/", 1)[1]) for v, r in rules]
    return sorted(split, key=lambda x: (-len(x[1]), -len(x[2]), x[1]))


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    out = None
    for _, rule, h, p in _ordered(rules):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, rule) if out is None else out.when(fits, rule)
    return out if out is not None else F.lit(None).cast("string")


def _shape(path: Column) -> Column:
    """The segments, joined; empty ones don't count."""
    return F.concat_ws("/", F.filter(F.split(path, "/"), lambda s: s != ""))


def templates(shapes: DataFrame) -> DataFrame:
    """shapes (host, shape, n, blocked, labelled) with the template of each."""
    names = ["host", "shape", "n", "blocked", "labelled", "template"]
    tree = shapes.withColumn("template", F.lit("")).withColumn("segments", F.when(F.col("shape") == "", F.array().cast("array<string>")).otherwise(F.split("shape", "/")))
    done = []
    while True:
        level = len(done)
        at = lambda k: F.coalesce(F.get("segments", F.lit(k)), F.lit(""))
        alone = tree.groupBy("host", "template").agg(F.count(F.lit(1)).alias("shapes"))
        tree = join_dealt(tree, alone, ["host", "template"], SPLIT)
        left = F.array_join(F.slice("segments", level + 1, F.greatest(F.lit(1), F.size("segments"))), "/")
        ended = F.size("segments") <= level
        done.append(tree.where(ended | (F.col("shapes") == 1)).select(*names[:-1], F.when(ended, F.col("template")).otherwise(F.concat("template", F.lit("/"), left)).alias("template")))
        tree = tree.where(~ended & (F.col("shapes") > 1)).withColumn("segment", at(level)).withColumn("next", at(level + 1)).drop("shapes")
        cell = tree.groupBy("host", "template", "segment", "next").agg(F.sum("n").alias("a"), F.sum("blocked").alias("b"), F.sum("labelled").alias("l"))
        column = cell.groupBy("host", "template", "next").agg(F.sum("a").alias("t"))
        child = cell.join(column, ["host", "template", "next"]).groupBy("host", "template", "segment").agg(
            F.sum("a").alias("c_n"), F.sum("b").alias("c_b"), F.sum("l").alias("c_l"), F.sum((F.col("a") * F.col("a")).cast("double") / F.col("t")).alias("s")
        )
        parent = child.groupBy("host", "template").agg(F.sum("c_n").alias("p_n"), F.sum("c_b").alias("p_b"), F.sum("c_l").alias("p_l"))
        parent = parent.join(column.groupBy("host", "template").agg(F.count(F.lit(1)).alias("k")), ["host", "template"])
        # Two proportions: the branch against its siblings.
        rest_b, rest_l, rest_n = F.col("p_b") - F.col("c_b"), F.col("p_l") - F.col("c_l"), F.col("p_n") - F.col("c_n")
        gap = (F.col("c_b") * rest_l - rest_b * F.col("c_l")).cast("double")
        spread = (F.col("c_l") * rest_l).cast("double") * F.col("p_b") * (F.col("p_l") - F.col("p_b"))
        blocked_otherwise = gap * gap * F.col("p_l") > Z * Z * spread
        # Chi-square of the next segments' counts, branch against siblings, beyond its mean by Z deviations.
        n, c = F.col("p_n").cast("double"), F.col("c_n").cast("double")
        chi = n * n / (c * rest_n) * (F.col("s") - c * c / n)
        free = (F.col("k") - 1).cast("double")
        followed_otherwise = (free > 0) & (chi > free + Z * F.sqrt(2 * free))
        literal = join_dealt(child, parent, ["host", "template"], SPLIT).where((rest_n == 0) | blocked_otherwise | followed_otherwise).select("host", "template", "segment", F.lit(True).alias("literal"))
        tree = join_dealt(tree, literal, ["host", "template", "segment"], SPLIT)
        tree = tree.withColumn("template", F.concat("template", F.lit("/"), F.when(F.col("literal"), F.col("segment")).otherwise("*"))).select(*names, "segments")
        tree = materialize(tree, "url-tree")
        if tree.isEmpty():
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and template of every page."""
    host, path = host_and_path(F.col("url"))
    parsed = pages.select(F.col("page_id"), host.alias("host"), path.alias("path"))
    blocked = [r for v, r in rules if v == "block"]
    parsed = parsed.select("page_id", "host", "path", matched_rule(F.col("host"), F.col("path"), rules).alias("rule"), _shape(F.col("path")).alias("shape"))
    by_rule = F.when(F.col("rule").isNotNull(), F.when(F.col("rule").isin(blocked), "block").otherwise("allow")) if blocked else F.when(F.col("rule").isNotNull(), F.lit("allow"))
    shapes = parsed.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(by_rule == "block", 1).otherwise(0)).alias("blocked"), F.sum(F.when(F.col("rule").isNotNull(), 1).otherwise(0)).alias("labelled"))
    named = materialize(templates(materialize(shapes, "url-shapes")), "url-templates")
    own = named.groupBy("host", "template").agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l"))
    shared = named.groupBy("template").agg(F.sum("blocked").alias("tb"), F.sum("labelled").alias("tl"))
    total = named.agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l")).first()  # one row
    base = (float(total["b"] or 0) + 1.0) / (float(total["l"] or 0) + 2.0)
    smoothed = (F.col("b") + PRIOR * ((F.col("tb") + PRIOR * F.lit(base)) / (F.col("tl") + PRIOR))) / (F.col("l") + PRIOR)
    verdicts = join_dealt(own, shared, ["template"], SPLIT).select("host", "template", F.when(smoothed >= REJECT, "block").otherwise("allow").alias("by_template"))
    verdicts = join_dealt(named.select("host", "shape", "template", "n"), verdicts, ["host", "template"], SPLIT)
    out = join_dealt(parsed, verdicts.drop("n"), ["host", "shape"], SPLIT)
    return out.select("page_id", "host", "path", "rule", F.coalesce(by_rule, "by_template").alias("verdict"), "template")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "pages"))


def oracle(rules: list[tuple[str, str]] = RULES, levels: int = ORACLE_LEVELS) -> str:
    """The same in DuckDB's SQL, for paths of up to `levels` segments."""
    fits = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{r}'" for _, r, h, p in _ordered(rules))
    verdict = "CASE " + " ".join(f"WHEN rule = '{r}' THEN '{v}'" for v, r in rules) + " END"
    parts = [
        "raw AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        "cut AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM raw)",
        f"hp AS (SELECT page_id, translate(h, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM cut)",
        f"seg AS (SELECT *, CASE {fits} END AS rule, list_filter(string_split(path, '/'), lambda s: s <> '') AS segments FROM hp)",
        f"parsed AS (SELECT page_id, host, path, rule, {verdict} AS by_rule, segments, array_to_string(segments, '/') AS shape FROM seg)",
        "t0 AS (SELECT host, shape, segments, '' AS template, count(*) AS n, sum(CASE WHEN by_rule = 'block' THEN 1 ELSE 0 END) AS blocked, count(rule) AS labelled FROM parsed GROUP BY host, shape, segments)",
    ]
    for i in range(1, levels + 1):
        parts += [
            f"g{i} AS (SELECT *, coalesce(segments[{i}], '') AS segment, coalesce(segments[{i + 1}], '') AS next FROM t{i - 1} WHERE len(segments) >= {i})",
            f"e{i} AS (SELECT host, template, segment, next, sum(n) AS a, sum(blocked) AS b, sum(labelled) AS l FROM g{i} GROUP BY ALL)",
            f"q{i} AS (SELECT host, template, next, sum(a) AS t FROM e{i} GROUP BY ALL)",
            f"c{i} AS (SELECT host, template, segment, sum(a) AS c_n, sum(b) AS c_b, sum(l) AS c_l, sum((a * a)::DOUBLE / t) AS s FROM e{i} JOIN q{i} USING (host, template, next) GROUP BY ALL)",
            f"p{i} AS (SELECT host, template, sum(c_n) AS p_n, sum(c_b) AS p_b, sum(c_l) AS p_l, any_value(k) AS k FROM c{i} JOIN (SELECT host, template, count(*) AS k FROM q{i} GROUP BY ALL) USING (host, template) GROUP BY ALL)",
            f"l{i} AS (SELECT host, template, segment FROM c{i} JOIN p{i} USING (host, template) WHERE p_n = c_n"
            f" OR ((c_b * (p_l - c_l) - (p_b - c_b) * c_l)::DOUBLE * (c_b * (p_l - c_l) - (p_b - c_b) * c_l)::DOUBLE) * p_l > {Z * Z}::DOUBLE * ((c_l * (p_l - c_l))::DOUBLE * p_b * (p_l - p_b))"
            f" OR k > 1 AND p_n::DOUBLE * p_n / (c_n::DOUBLE * (p_n - c_n)) * (s - c_n::DOUBLE * c_n / p_n) > (k - 1) + {Z}::DOUBLE * sqrt(2.0::DOUBLE * (k - 1)))",
            f"t{i} AS (SELECT t.host, t.shape, t.segments, t.template || CASE WHEN len(t.segments) < {i} THEN '' WHEN l.segment IS NULL THEN '/*' ELSE '/' || l.segment END AS template, t.n, t.blocked, t.labelled FROM t{i - 1} t LEFT JOIN l{i} l ON t.host = l.host AND t.template = l.template AND t.segments[{i}] = l.segment)",
        ]
    parts += [
        f"named AS (SELECT host, shape, template, blocked, labelled FROM t{levels})",
        "own AS (SELECT host, template, sum(blocked)::DOUBLE AS b, sum(labelled)::DOUBLE AS l FROM named GROUP BY ALL)",
        "shared AS (SELECT template, sum(blocked)::DOUBLE AS tb, sum(labelled)::DOUBLE AS tl FROM named GROUP BY ALL)",
        "base AS (SELECT (sum(blocked)::DOUBLE + 1.0) / (sum(labelled)::DOUBLE + 2.0) AS g FROM named)",
        f"judged AS (SELECT host, template, CASE WHEN (b + {PRIOR}::DOUBLE * ((tb + {PRIOR}::DOUBLE * (SELECT g FROM base)) / (tl + {PRIOR}::DOUBLE))) / (l + {PRIOR}::DOUBLE) >= {REJECT}::DOUBLE THEN 'block' ELSE 'allow' END AS by_template FROM own JOIN shared USING (template))",
    ]
    return "WITH " + ", ".join(parts) + " SELECT p.page_id, p.host, p.path, p.rule, coalesce(p.by_rule, j.by_template) AS verdict, n.template FROM parsed p LEFT JOIN named n ON p.host = n.host AND p.shape = n.shape LEFT JOIN judged j ON n.host = j.host AND n.template = j.template"
