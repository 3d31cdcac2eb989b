"""Queries of retrieval: scope filters, lexical, vector and hybrid search, graph expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph as gr
from ..operators import hybrid as hy
from ..operators import lexical as lx
from ..operators import scope as sc
from ..operators import vector as ve
from ..session import materialize
from ..sources.tables import table
from .registry import Registry

reg = Registry()
DAY = "2020-06-30"
QUERY = "snippet window blocked two teams"
NUMBERS = "after 5 m or 75k seats"


def pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mem_pages")


def _filter(name: str, sql: str, **scope) -> None:
    reg(name, f"SELECT page_id, slug FROM mem_pages WHERE {sql}")(
        lambda spark, d: sc.apply_scope(pages(spark, d), **scope).select("page_id", "slug")
    )


_ALL = {"include_superseded": True, "include_quarantined": True}
_filter("b01_scope_wing", "wing = 'projects'", wing="projects", **_ALL)
_filter("b02_scope_collection", "collection_id = 1", collection_id=1, **_ALL)
_filter("b03_scope_namespace", "namespace_id IN ('team-orchard', '')", namespace="team-orchard", **_ALL)
_filter("b03_scope_global", "namespace_id = ''", namespace="", **_ALL)
_filter("b04_scope_superseded", "superseded_by IS NULL", include_quarantined=True)
_filter("b05_scope_quarantined", "quarantined_at IS NULL", include_superseded=True)


@reg("b07_exact_slug", """
SELECT page_id, slug, CAST(1 AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY CASE WHEN namespace_id = 'team-orchard' THEN 0 ELSE 1 END, page_id) AS rn
  FROM mem_pages WHERE namespace_id IN ('team-orchard', '') AND superseded_by IS NULL AND quarantined_at IS NULL) WHERE rn = 1""")  # fmt: skip
def b07(spark, d):
    """Every slug as its own exact query in one namespace."""
    live = sc.apply_scope(pages(spark, d), namespace="team-orchard")
    return sc.prefer_namespace(live, ["slug"], "team-orchard").select("page_id", "slug", F.lit(1.0).alias("score"))


@reg("b08_canonical_slug", "SELECT page_id, coll_name || '::' || slug AS canonical FROM mem_pages JOIN collections USING (collection_id)")
def b08(spark, d):
    return pages(spark, d).join(table(spark, d, "collections"), "collection_id").select("page_id", F.concat("coll_name", F.lit("::"), "slug").alias("canonical"))


@reg("b06_exact_slug_short_circuit", "SELECT page_id, slug, CAST(1 AS DOUBLE) AS score FROM mem_pages WHERE page_id % 50 = 0 AND superseded_by IS NULL AND quarantined_at IS NULL")
def b06(spark, d):
    """[[slug]] of every page whose id is divisible by 50, looked up among all pages."""
    live = sc.apply_scope(pages(spark, d))
    asked = pages(spark, d).where("page_id % 50 = 0").select(F.regexp_replace(F.concat(F.lit("[["), "slug", F.lit("]]")), r"^\[\[|\]\]$", "").alias("slug"))
    return live.join(asked, "slug", "left_semi").select("page_id", "slug", F.lit(1.0).alias("score"))


@reg("b12_page_listing", "SELECT coll_name || '::' || slug AS canonical, page_type, summary FROM mem_pages JOIN collections USING (collection_id) WHERE wing = 'people' ORDER BY updated_at DESC, slug LIMIT 50")
def b12(spark, d):
    p = pages(spark, d).where("wing = 'people'").orderBy(F.col("updated_at").desc(), "slug").limit(50)
    return p.join(table(spark, d, "collections"), "collection_id").select(F.concat("coll_name", F.lit("::"), "slug").alias("canonical"), "page_type", "summary")


@reg("b14_active_links", f"SELECT link_id FROM links WHERE (valid_from IS NULL OR valid_from <= '{DAY}') AND (valid_until IS NULL OR valid_until >= '{DAY}')")
def b14(spark, d):
    return table(spark, d, "links").where(sc.active_on(DAY)).select("link_id")


@reg("b15_any_namespace", """
SELECT collection_id, slug, page_id FROM (SELECT *, row_number() OVER (PARTITION BY collection_id, slug ORDER BY CASE WHEN namespace_id = '' THEN 0 ELSE 1 END, namespace_id, page_id) AS rn FROM mem_pages) WHERE rn = 1""")  # fmt: skip
def b15(spark, d):
    w = Window.partitionBy("collection_id", "slug").orderBy(F.when(F.col("namespace_id") == "", 0).otherwise(1), "namespace_id", "page_id")
    return pages(spark, d).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("collection_id", "slug", "page_id")


@reg("b16_slug_owners", "SELECT slug, count(*) AS owners, CASE WHEN count(*) = 1 THEN 'resolved' ELSE 'ambiguous' END AS outcome, array_to_string(list_sort(list(coll_name)), ';') AS names FROM mem_pages JOIN collections USING (collection_id) GROUP BY slug")
def b16(spark, d):
    owned = pages(spark, d).join(table(spark, d, "collections"), "collection_id")
    # A slug is unique within a collection, so a list has at most one name a collection.
    g = owned.groupBy("slug").agg(F.count("*").alias("owners"), F.array_join(F.sort_array(F.collect_set("coll_name")), ";").alias("names"))
    return g.select("slug", "owners", F.when(F.col("owners") == 1, "resolved").otherwise("ambiguous").alias("outcome"), "names")


@reg("b17_read_collection", "SELECT coll_name FROM collections WHERE CASE WHEN (SELECT count(*) FROM collections WHERE coll_state = 'active') = 1 THEN coll_state = 'active' ELSE is_write_target = 1 END")
def b17(spark, d):
    c = table(spark, d, "collections")
    n = F.count_if(F.col("coll_state") == "active").over(Window.partitionBy(F.lit(1)))
    return c.withColumn("n", n).where(F.when(F.col("n") == 1, F.col("coll_state") == "active").otherwise(F.col("is_write_target") == 1)).select("coll_name")


@reg("b18_db_only_state", """
SELECT page_id, page_id IN (SELECT from_page_id FROM links WHERE source_kind = 'programmatic' UNION SELECT to_page_id FROM links WHERE source_kind = 'programmatic')
  OR page_id IN (SELECT page_id FROM assertions WHERE asserted_by <> 'import') OR page_id IN (SELECT page_id FROM knowledge_gaps WHERE page_id IS NOT NULL) AS db_only FROM mem_pages""")  # fmt: skip
def b18(spark, d):
    links = table(spark, d, "links").where("source_kind = 'programmatic'")
    marks = links.select(F.explode(F.array("from_page_id", "to_page_id")).alias("page_id"))
    marks = marks.unionByName(table(spark, d, "assertions").where("asserted_by <> 'import'").select("page_id")).unionByName(table(spark, d, "knowledge_gaps").select("page_id"))
    marks = marks.where("page_id is not null").distinct().withColumn("m", F.lit(True))
    return pages(spark, d).select("page_id").join(marks, "page_id", "left").select("page_id", F.coalesce("m", F.lit(False)).alias("db_only"))


# --- lexical -----------------------------------------------------------------------------------------------------------------

_built: dict[tuple, lx.Postings] = {}


def postings(spark: SparkSession, d: str, mode: str = "plain") -> lx.Postings:
    """The index of the table's pages, built once for what is stored there: another path or time of change is another index."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/mem_pages.parquet")
    changed = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).getModificationTime()
    key = (spark.sparkContext.applicationId, d, changed, mode)
    if key not in _built:
        _built[key] = lx.build(lx.index(pages(spark, d), mode))
    return _built[key]


_TOK = "CASE WHEN {0} IS NULL THEN [] ELSE regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+') END"
_INDEX = "idx AS (SELECT page_id, slug, wing, superseded_by, " + ", ".join(f"{_TOK.format(c)} AS t_{c}" for c in lx.COLUMNS) + " FROM mem_pages WHERE quarantined_at IS NULL)"


def _phrase_sql(words: list[str]) -> str:
    want = "[" + ", ".join(f"'{w}'" for w in words) + "]"
    one = "len(list_filter(t_{0}, lambda x: x = " + f"'{words[0]}'" + "))"
    many = "len(list_filter(range(1, greatest(2, len(t_{0}) - " + str(len(words) - 2) + ")), lambda i: list_slice(t_{0}, i, i + " + str(len(words) - 1) + f") = {want}))"
    return " + ".join((one if len(words) == 1 else many).format(c) for c in lx.COLUMNS)


def _bm25_sql(query: str, every: bool, where: str = "TRUE") -> str:
    q = lx.clauses(lx.sanitize(query))
    flat = [p for cl in q for p in cl]
    counts = ", ".join(f"{_phrase_sql(p)} AS f{i}" for i, p in enumerate(flat))
    dl = " + ".join(f"len(t_{c})" for c in lx.COLUMNS)
    stats = ", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in range(len(flat)))
    parts = [
        f"CASE WHEN f{i} > 0 THEN (CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) > 0 THEN greatest(1e-6, ln((n - n{i} + 0.5) / (n{i} + 0.5))) ELSE 1e-6 END) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END"
        for i in range(len(flat))
    ]
    at, hits = 0, []
    for cl in q:
        hits.append("(" + " OR ".join(f"f{at + k} > 0" for k in range(len(cl))) + ")")
        at += len(cl)
    return f"""WITH {_INDEX}, cnt AS (SELECT *, {dl} AS dl, {counts} FROM idx), st AS (SELECT count(*) AS n, avg(dl) AS avgdl, {stats} FROM cnt),
scored AS (SELECT page_id, slug, wing, superseded_by, {' + '.join(parts)} AS score FROM cnt, st WHERE {(' AND ' if every else ' OR ').join(hits)})
SELECT page_id, slug, round(score, 6) AS score FROM scored WHERE {where}"""


def _scored(df: DataFrame) -> DataFrame:
    return df.select("page_id", "slug", F.round("score", 6).alias("score"))


@reg("h03_bm25_every_word", _bm25_sql(QUERY, True))
def h03(spark, d):
    return _scored(lx.bm25(postings(spark, d), lx.clauses(lx.sanitize(QUERY)), True))


@reg("h04_bm25_any_word", _bm25_sql(QUERY, False))
def h04(spark, d):
    return _scored(lx.bm25(postings(spark, d), lx.clauses(lx.sanitize(QUERY)), False))


@reg("h09_numeric_aliases", _bm25_sql(NUMBERS, False))
def h09(spark, d):
    return _scored(lx.bm25(postings(spark, d), lx.clauses(lx.sanitize(NUMBERS)), False))


_LIVE = "superseded_by IS NULL AND wing = 'projects'"


def _live(df: DataFrame) -> DataFrame:
    return df.where(_LIVE)


@reg("f01_bm25_top", f"SELECT * FROM ({_bm25_sql(QUERY, False, _LIVE)}) ORDER BY score DESC, page_id LIMIT 20")
def f01(spark, d):
    hits = lx.bm25(postings(spark, d), lx.clauses(lx.sanitize(QUERY)), False, _live)
    return lx.top(_scored(hits), 20)


_TIERED = f"""
WITH a AS (SELECT *, row_number() OVER (ORDER BY score DESC, page_id) AS rn FROM ({_bm25_sql(QUERY, True)}) ORDER BY rn LIMIT 1000),
o AS (SELECT *, row_number() OVER (ORDER BY score DESC, page_id) AS rn FROM ({_bm25_sql(QUERY, False)}) WHERE page_id NOT IN (SELECT page_id FROM a)),
u AS (SELECT page_id, slug, 0 AS tier, rn FROM a UNION ALL SELECT page_id, slug, 1, rn FROM o)
SELECT page_id, slug, tier FROM u ORDER BY tier, rn LIMIT 1000"""


@reg("h05_tiered_search", _TIERED)
def h05(spark, d):
    return lx.tiered(postings(spark, d), lx.sanitize(QUERY), 1000).select("page_id", "slug", "tier")


_RAW = '(title : "token budget" OR snippet win*) NOT teams'


@reg("h06_expert_query", f"""WITH {_INDEX} SELECT page_id, slug FROM idx WHERE
 ((len(list_filter(range(1, greatest(2, len(t_title))), lambda i: list_slice(t_title, i, i + 1) = ['token', 'budget'])) > 0)
 OR (({_phrase_sql(['snippet'])} > 0) AND ({' + '.join("len(list_filter(t_" + c + ", lambda x: starts_with(x, 'win')))" for c in lx.COLUMNS)} > 0)))
 AND NOT ({_phrase_sql(['teams'])} > 0)""")  # fmt: skip
def h06(spark, d):
    return lx.index(pages(spark, d)).where(lx.raw_match(lx.parse_raw(_RAW))).select("page_id", "slug")


@reg("h13_phrase_match", f"WITH {_INDEX} SELECT page_id, {_phrase_sql(['second', 'look'])} AS n FROM idx WHERE {_phrase_sql(['second', 'look'])} > 0", longs=('n',))
def h13(spark, d):
    return lx.index(pages(spark, d)).withColumn("n", lx.phrase_count(["second", "look"])).where("n > 0").select("page_id", "n")


@reg("h02_porter_tokens")
def h02(spark, d):
    """Stemmed tokens with folded diacritics; SQL has no stemmer."""
    return lx.index(pages(spark, d), "porter").select("page_id", "dl", F.array_join("t_title", " ").alias("title_tokens"))


@reg("h07_porter_search")
def h07(spark, d):
    q = [[[lx.porter.stem(w)]] for w in ("snippet", "windows", "blocked")]
    return _scored(lx.bm25(postings(spark, d, "porter"), q, False))


@reg("h14_postings", f"WITH {_INDEX}, x AS (SELECT page_id, unnest(list_concat(t_title, list_concat(t_slug, list_concat(t_compiled_truth, t_timeline)))) AS term FROM idx) SELECT term, count(DISTINCT page_id) AS pages, count(*) AS occurrences FROM x GROUP BY term")
def h14(spark, d):
    """What the written index holds of every word."""
    return postings(spark, d).postings.groupBy("term").agg(F.count("*").alias("pages"), F.sum(F.size("places").cast("long")).alias("occurrences"))


# --- vectors -----------------------------------------------------------------------------------------------------------------

_COS = "list_cosine_similarity(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    return list(table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"])


@reg("i12_cosine", f"SELECT a.vec_id, round({_COS.format('a.embedding', 'q.embedding')}, 6) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) q")
def i12(spark, d):
    return ve.score_against(table(spark, d, "embeddings"), _query_vector(spark, d)).select("vec_id", F.round("score", 6).alias("score"))


@reg("i13_cosine_guarded", f"SELECT a.vec_id, round(coalesce({_COS.format('a.embedding', 'b.embedding')}, 0), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def i13(spark, d):
    e = table(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", F.round(ve.cosine(F.col("embedding"), F.col("other")), 6).alias("score"))


_KNN = f"""SELECT query_id, id, round(s, 6) AS score, rn AS rank FROM (
  SELECT q.vec_id AS query_id, r.vec_id AS id, {_COS.format('q.embedding', 'r.embedding')} AS s,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS.format('q.embedding', 'r.embedding')}, 12) DESC, r.vec_id) AS rn
  FROM embeddings q, embeddings r WHERE q.vec_id % 50 = 0) WHERE rn <= 10"""


@reg("f02_knn", _KNN, longs=('rank',))
def f02(spark, d):
    """The ten nearest of every vector whose id is divisible by 50, against all vectors."""
    e = table(spark, d, "embeddings")
    return ve.knn(e, e.where("vec_id % 50 = 0"), 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@reg("d01_best_chunk", f"SELECT label, round(max({_COS.format('a.embedding', 'q.embedding')}), 6) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) q GROUP BY label")
def d01(spark, d):
    s = ve.best_chunk(ve.score_against(table(spark, d, "embeddings"), _query_vector(spark, d)), "label")
    return s.select("label", F.round("score", 6).alias("score"))


@reg("b11_cosine_floor", f"SELECT vec_id FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE {_COS.format('a.embedding', 'q.embedding')} >= 0.2")
def b11(spark, d):
    return sc.floor(ve.score_against(table(spark, d, "embeddings"), _query_vector(spark, d)), 0.2).select("vec_id")


@reg("i14_vector_search", f"""
SELECT page_id, slug, round(score, 6) AS score FROM (SELECT p.page_id, p.slug, max({_COS.format('e.embedding', 'q.embedding')}) AS score
  FROM mem_pages p JOIN embeddings e ON e.vec_id = p.page_id, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
  WHERE p.superseded_by IS NULL AND p.quarantined_at IS NULL AND p.namespace_id IN ('team-orchard', '') GROUP BY 1, 2) ORDER BY score DESC, page_id LIMIT 25""")  # fmt: skip
def i14(spark, d):
    return _vector_arm(spark, d, "team-orchard").orderBy(F.col("score").desc(), "page_id").limit(25).select("page_id", "slug", F.round("score", 6).alias("score"))


def _vector_arm(spark: SparkSession, d: str, namespace: str | None = None) -> DataFrame:
    live = sc.apply_scope(pages(spark, d), namespace=namespace).select("page_id", "slug")
    e = table(spark, d, "embeddings").withColumnRenamed("vec_id", "page_id")
    s = ve.score_against(e.join(live.select("page_id"), "page_id", "left_semi"), _query_vector(spark, d))
    return ve.best_chunk(s, "page_id").join(live, "page_id")


@reg("i07_hash_embedding")
def i07(spark, d):
    return ve.embed(pages(spark, d).select("page_id", "title"), "title", 64)


# --- fusion ------------------------------------------------------------------------------------------------------------------

_VEC = f"SELECT p.slug, max({_COS.format('e.embedding', 'q.embedding')}) AS score FROM mem_pages p JOIN embeddings e ON e.vec_id = p.page_id, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE p.superseded_by IS NULL AND p.quarantined_at IS NULL GROUP BY 1 ORDER BY score DESC, slug LIMIT 200"
_LEX = f"SELECT slug, score FROM ({_bm25_sql(QUERY, False, 'superseded_by IS NULL')}) ORDER BY score DESC, slug LIMIT 200"


def _arms(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    hits = _scored(lx.bm25(postings(spark, d), lx.clauses(lx.sanitize(QUERY)), False, lambda x: x.where("superseded_by is null")))
    lex = hits.select("slug", "score").orderBy(F.col("score").desc(), "slug").limit(200)
    vec = _vector_arm(spark, d).select("slug", "score").orderBy(F.col("score").desc(), "slug").limit(200)
    return lex, vec


_UNION = f"WITH l AS ({_LEX}), v AS ({_VEC}), lm AS (SELECT greatest(0, max(score)) AS m FROM l), vm AS (SELECT greatest(0, max(score)) AS m FROM v) SELECT coalesce(l.slug, v.slug) AS slug, coalesce(0.4 * l.score / lm.m, 0) + coalesce(0.6 * v.score / vm.m, 0) AS score FROM l FULL JOIN v USING (slug), lm, vm"


@reg("g02_union_fusion", f"SELECT slug, round(score, 5) AS score FROM ({_UNION})")
def g02(spark, d):
    return hy.union(*_arms(spark, d)).select("slug", F.round("score", 5).alias("score"))


@reg("e01_reciprocal_ranks", f"""
WITH l AS (SELECT slug, row_number() OVER (ORDER BY score DESC, slug) AS rn FROM ({_LEX})), v AS (SELECT slug, row_number() OVER (ORDER BY score DESC, slug) AS rn FROM ({_VEC})),
u AS (SELECT * FROM l UNION ALL SELECT * FROM v) SELECT slug, round(sum(1.0 / (60 + rn)) * 30.5, 9) AS score FROM u GROUP BY slug""")  # fmt: skip
def e01(spark, d):
    return hy.reciprocal_ranks(list(_arms(spark, d))).select("slug", F.round("score", 9).alias("score"))


@reg("e02_limit_per_page", f"""
SELECT label, vec_id, CASE WHEN rn = 1 THEN greatest(0, n - 3) ELSE 0 END AS collapsed FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY round(s, 9) DESC, vec_id) AS rn, count(*) OVER (PARTITION BY label) AS n
 FROM (SELECT a.label, a.vec_id, {_COS.format('a.embedding', 'q.embedding')} AS s FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)) WHERE rn <= 3""")  # fmt: skip
def e02(spark, d):
    s = ve.score_against(table(spark, d, "embeddings"), _query_vector(spark, d)).withColumn("score", F.round("score", 9))
    return hy.limit_per_page(s, 3, "label", "vec_id").select("label", "vec_id", "collapsed")


@reg("b10_relevance_floor", f"SELECT slug, round(score, 5) AS score FROM ({_UNION}) WHERE round(score, 5) >= 0.3")
def b10(spark, d):
    return sc.floor(g02(spark, d), 0.3)


@reg("f05_merged_order", f"SELECT slug, round(score, 5) AS score FROM ({_UNION}) ORDER BY score DESC, slug LIMIT 10")
def f05(spark, d):
    return g02(spark, d).orderBy(F.col("score").desc(), "slug").limit(10)


@reg("b20_budget_trim", f"""
WITH t AS (SELECT slug, round(score, 5) AS score FROM ({_UNION}) ORDER BY score DESC, slug LIMIT 50), s AS (SELECT t.slug, t.score, coalesce(p.summary, '') AS summary FROM t JOIN mem_pages p USING (slug)),
r AS (SELECT *, sum(length(slug) + 2 + length(summary)) OVER (ORDER BY score DESC, slug ROWS UNBOUNDED PRECEDING) AS used FROM s)
SELECT slug, substr(summary, 1, CAST(4000 - (used - length(slug) - 2 - length(summary)) - length(slug) - 2 AS INTEGER)) AS summary FROM r WHERE 4000 - (used - length(slug) - 2 - length(summary)) - length(slug) - 2 > 0""")  # fmt: skip
def b20(spark, d):
    t = g02(spark, d).orderBy(F.col("score").desc(), "slug").limit(50)
    s = t.join(pages(spark, d).select("slug", F.coalesce("summary", F.lit("")).alias("summary")), "slug")
    return hy.trim_to_budget(s, 4000, [F.col("score").desc(), F.col("slug")]).select("slug", "summary")


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).where("page_id % 50 = 0").select("page_id", (F.lit(1.0) / (1 + F.col("page_id") % 7)).alias("score"))


@reg("j03_graph_expansion", f"""
WITH seeds AS (SELECT page_id, 1.0 / (1 + page_id % 7) AS score FROM mem_pages WHERE page_id % 50 = 0),
e AS (SELECT DISTINCT l.* FROM links l JOIN mem_pages p ON p.page_id = l.to_page_id AND p.superseded_by IS NULL AND p.quarantined_at IS NULL
  WHERE (l.valid_from IS NULL OR l.valid_from <= '{DAY}') AND (l.valid_until IS NULL OR l.valid_until >= '{DAY}') AND l.to_page_id NOT IN (SELECT page_id FROM seeds)),
h1 AS (SELECT e.to_page_id AS dst, s.score * e.edge_weight * 0.5 AS score, s.score AS parent, e.from_page_id AS src, e.link_id FROM e JOIN seeds s ON s.page_id = e.from_page_id),
f1 AS (SELECT dst, score FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY parent DESC, src, link_id) AS rn FROM h1) WHERE rn = 1),
h2 AS (SELECT e.to_page_id AS dst, f1.score * e.edge_weight * 0.25 AS score FROM e JOIN f1 ON f1.dst = e.from_page_id)
SELECT dst AS page_id, round(max(score), 9) AS score FROM (SELECT dst, score FROM h1 UNION ALL SELECT dst, score FROM h2) GROUP BY 1 ORDER BY max(score) DESC, 1 LIMIT 50""")  # fmt: skip
def j03(spark, d):
    out = gr.expand(_seeds(spark, d), table(spark, d, "links").dropDuplicates(["link_id"]), pages(spark, d), DAY, 2)
    return out.select("page_id", F.round("score", 9).alias("score"))


@reg("j01_neighbourhood", """
WITH RECURSIVE e AS (SELECT from_page_id AS a, to_page_id AS b FROM links WHERE from_page_id <> to_page_id
  UNION SELECT page_id, superseded_by FROM mem_pages WHERE superseded_by IS NOT NULL UNION SELECT superseded_by, page_id FROM mem_pages WHERE superseded_by IS NOT NULL),
r AS (SELECT CAST(50 AS BIGINT) AS page_id, 0 AS depth UNION SELECT e.b, r.depth + 1 FROM r JOIN e ON e.a = r.page_id JOIN mem_pages p ON p.page_id = e.b WHERE r.depth < 3)
SELECT page_id, min(depth) AS depth FROM r GROUP BY 1""")  # fmt: skip
def j01(spark, d):
    nodes, _ = gr.neighbourhood(table(spark, d, "links"), pages(spark, d), 50, 3)
    return nodes.select("page_id", "depth")


@reg("j02_paths")
def j02(spark, d):
    nodes, _ = gr.neighbourhood(table(spark, d, "links"), pages(spark, d), 50, 3, DAY)
    return nodes.select("page_id", "slug", "depth", F.to_json("path").alias("path"))


@reg("n20_cross_reference", f"""
WITH r AS (SELECT page_id, 1.0 / (1 + page_id % 7) AS score FROM mem_pages WHERE page_id % 50 = 0),
b AS (SELECT to_page_id AS page_id, least(0.15, 0.05 * sum(edge_weight)) AS boost FROM (SELECT DISTINCT * FROM links) l WHERE (valid_from IS NULL OR valid_from <= '{DAY}') AND (valid_until IS NULL OR valid_until >= '{DAY}')
  AND from_page_id IN (SELECT page_id FROM r) AND to_page_id IN (SELECT page_id FROM r) AND from_page_id <> to_page_id GROUP BY 1)
SELECT r.page_id, round(coalesce(b.boost, 0), 9) AS boost FROM r LEFT JOIN b USING (page_id)""")  # fmt: skip
def n20(spark, d):
    out = gr.cross_reference_boost(_seeds(spark, d), table(spark, d, "links").dropDuplicates(["link_id"]), DAY)
    return out.select("page_id", F.round("boost", 9).alias("boost"))


@reg("g01_hybrid_search", f"SELECT slug, round(score, 5) AS score FROM ({_UNION}) WHERE round(score, 5) >= 0.1 ORDER BY score DESC, slug LIMIT 10")
def g01(spark, d):
    """The flagship: scope, both arms, fusion, floor and order."""
    return sc.floor(g02(spark, d), 0.1).orderBy(F.col("score").desc(), "slug").limit(10)


QUERIES, SQL = reg.queries, reg.sql
