"""Queries and SQL of the general operators: day intervals (p2) and hierarchies (p5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hierarchy as hi
from ..operators import intervals as iv
from ..sources.tables import table


def _key(*parts: Column) -> Column:
    return F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def link_spans(links: DataFrame) -> DataFrame:
    return iv.intervals(links, _key(F.col("from_page_id"), F.col("to_page_id"), F.lower(F.trim("relationship"))))


def assertion_spans(assertions: DataFrame) -> DataFrame:
    return iv.intervals(assertions, _key(F.col("page_id"), F.lower(F.trim("predicate"))))


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of both tables in one sort: the table's name leads the entity."""
    parts = [("links", link_spans(table(spark, sf_dir, "links"))), ("assertions", assertion_spans(table(spark, sf_dir, "assertions")))]
    a, b = (s.withColumn("entity", F.concat_ws("|", F.lit(name), "entity")) for name, s in parts)
    return a.unionByName(b)


def _split(df: DataFrame) -> DataFrame:
    rest = [c for c in df.columns if c != "entity"]
    at = F.instr("entity", "|")
    return df.select(F.substring_index("entity", "|", 1).alias("record_table"), F.expr("substring(entity, instr(entity, '|') + 1)").alias("entity_key"), *rest)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(iv.gaps(_both(spark, sf_dir)))


def p2_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(iv.periods(_both(spark, sf_dir)))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hi.parent_edges(table(spark, sf_dir, "links"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hi.cycles(_edges(spark, sf_dir)).select(F.col("cycle_id").alias("cycle_page_id"), F.col("node").alias("page_id"))


def p5_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hi.hierarchy(_edges(spark, sf_dir))
    return out.withColumn("path", F.array_join("path", "/"))


def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything below each page whose id is divisible by 50: the stated queries of this search, against all places."""
    tree = hi.materialize(hi.hierarchy(_edges(spark, sf_dir)), "tree")
    return hi.descendants(tree, tree.select("page_id").where("page_id % 50 = 0"))


def p5_all_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything below each page, through cycles too. SQL would compare the paths of all places, so there is none: tests are against walks."""
    return hi.whole_descendants(_edges(spark, sf_dir))


def p5_whole_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p5_hierarchy with cycles folded, so that no page loses what lies below a cycle."""
    return hi.whole_hierarchy(_edges(spark, sf_dir)).withColumn("path", F.array_join("path", "/"))


QUERIES = {
    "p2_found": p2_found,
    "p2_periods": p2_periods,
    "p5_found": p5_found,
    "p5_hierarchy": p5_hierarchy,
    "p5_descendants": p5_descendants,
    "p5_all_descendants": p5_all_descendants,
    "p5_whole_hierarchy": p5_whole_hierarchy,
}

_SPANS = r"""
WITH raw AS (
  SELECT 'links' AS record_table,
         concat_ws('|', coalesce(CAST(from_page_id AS VARCHAR), ''), coalesce(CAST(to_page_id AS VARCHAR), ''), coalesce(lower(trim(relationship)), '')) AS entity_key,
         trim(coalesce(valid_from, '')) AS f, trim(coalesce(valid_until, '')) AS u FROM links
  UNION ALL
  SELECT 'assertions', concat_ws('|', coalesce(CAST(page_id AS VARCHAR), ''), coalesce(lower(trim(predicate)), '')),
         trim(coalesce(valid_from, '')), trim(coalesce(valid_until, '')) FROM assertions
), days AS (
  SELECT record_table, entity_key,
         CASE WHEN f = '' THEN -10000000 ELSE date_diff('day', DATE '1970-01-01', try_cast(regexp_replace(f, '^([0-9]{4})[-/]?([0-9]{2})[-/]?([0-9]{2}).*$', '\1-\2-\3') AS DATE)) END AS lo,
         CASE WHEN u = '' THEN 10000000 ELSE date_diff('day', DATE '1970-01-01', try_cast(regexp_replace(u, '^([0-9]{4})[-/]?([0-9]{2})[-/]?([0-9]{2}).*$', '\1-\2-\3') AS DATE)) END AS hi
  FROM raw
), reach AS (
  SELECT record_table, entity_key, lo, hi,
         max(hi) OVER (PARTITION BY record_table, entity_key ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM days WHERE lo <= hi
)"""

_CYCLES = r"""
WITH RECURSIVE edges AS (
  SELECT DISTINCT child, parent FROM (
    SELECT from_page_id AS child, to_page_id AS parent FROM links WHERE lower(trim(relationship)) = 'parent'
    UNION ALL SELECT to_page_id, from_page_id FROM links WHERE lower(trim(relationship)) = 'child'
  ) WHERE child IS NOT NULL AND parent IS NOT NULL
), reach AS (
  SELECT child AS a, parent AS b FROM edges
  UNION SELECT r.a, e.parent FROM reach r JOIN edges e ON e.child = r.b
), cyc AS (
  SELECT x.a AS node, min(x.b) AS cycle_id FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY 1
)"""
_TREE = (
    _CYCLES
    + """, kept AS (
  SELECT e.child, e.parent FROM edges e LEFT JOIN cyc c ON c.node = e.child LEFT JOIN cyc p ON p.node = e.parent
  WHERE e.child <> e.parent AND (c.cycle_id IS NULL OR p.cycle_id IS NULL OR c.cycle_id <> p.cycle_id)
), pages AS (SELECT child AS page FROM edges UNION SELECT parent FROM edges
), tree AS (
  SELECT page, CAST(NULL AS BIGINT) AS parent, [page] AS path FROM pages WHERE page NOT IN (SELECT child FROM kept)
  UNION ALL SELECT k.child, k.parent, list_append(t.path, k.child) FROM tree t JOIN kept k ON k.parent = t.page
), numbered AS (SELECT *, row_number() OVER (ORDER BY path) - 1 AS pre FROM tree
), below AS (
  SELECT a.pre, count(*) AS n FROM numbered a JOIN numbered b ON len(b.path) > len(a.path) AND b.path[1:len(a.path)] = a.path GROUP BY 1
)"""
)

SQL = {
    "p5_found": _CYCLES + " SELECT cycle_id AS cycle_page_id, node AS page_id FROM cyc",
    "p5_hierarchy": _TREE
    + """
SELECT t.page AS page_id, t.parent AS parent_id, t.path[1] AS root_id, len(t.path) - 1 AS depth, array_to_string(t.path, '/') AS path,
       t.pre AS pre, t.pre + coalesce(b.n, 0) AS post, coalesce(b.n, 0) AS n_descendants, c.cycle_id AS cycle_page_id
FROM numbered t LEFT JOIN below b ON b.pre = t.pre LEFT JOIN cyc c ON c.node = t.page""",
    "p5_descendants": _TREE
    + """
SELECT DISTINCT a.page AS page_id, b.page AS descendant_id
FROM numbered a JOIN numbered b ON len(b.path) > len(a.path) AND b.path[1:len(a.path)] = a.path WHERE a.page % 50 = 0""",
    "p2_found": _SPANS
    + """
SELECT DISTINCT record_table, entity_key,
       strftime(DATE '1970-01-01' + CAST(before + 1 AS INTEGER), '%Y-%m-%d') AS gap_from,
       strftime(DATE '1970-01-01' + CAST(lo - 1 AS INTEGER), '%Y-%m-%d') AS gap_until
FROM reach WHERE before IS NOT NULL AND lo > before + 1""",
    "p2_periods": _SPANS
    + """, islands AS (
  SELECT *, sum(CASE WHEN before IS NULL OR lo > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY record_table, entity_key ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM reach
), merged AS (
  SELECT record_table, entity_key, island, min(lo) AS lo, max(hi) AS hi FROM islands GROUP BY 1, 2, 3
)
SELECT record_table, entity_key,
       CASE WHEN lo > -10000000 THEN strftime(DATE '1970-01-01' + CAST(lo AS INTEGER), '%Y-%m-%d') END AS period_from,
       CASE WHEN hi < 10000000 THEN strftime(DATE '1970-01-01' + CAST(hi AS INTEGER), '%Y-%m-%d') END AS period_until
FROM merged""",
}
