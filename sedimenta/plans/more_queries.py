"""Further queries: maintenance of derived tables, queues and snapshots, and the facade's composed searches."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import conversation as cv
from ..operators import graph as gr
from ..operators import hybrid as hy
from ..operators import hygiene as hg
from ..operators import lexical as lx
from ..operators import scope as sc
from ..operators import sync as sy
from ..operators import vector as ve
from ..sources.tables import table
from . import search_queries as sq
from . import table_queries as tq
from .registry import Registry

reg = Registry()
NOW = tq.NOW


def now():
    return F.expr(f"TIMESTAMP_NTZ '{NOW}'")


@reg("b09_operator_only_query", """WITH q AS (SELECT doc_id AS id, text AS query FROM documents WHERE text IS NOT NULL UNION ALL SELECT * FROM (VALUES (-1, 'AND OR'), (-2, 'and or'), (-3, 'NOT "NEAR"'), (-4, '...'), (-5, 'ANDROID')))
SELECT id, regexp_matches(trim(regexp_replace(query, '[^\\p{L}\\p{N}]+', ' ', 'g')), '^(AND|NEAR|NOT|OR)( (AND|NEAR|NOT|OR))*$') AS only_operators FROM q""")
def b09(spark, d):
    said = spark.createDataFrame([(-1, "AND OR"), (-2, "and or"), (-3, 'NOT "NEAR"'), (-4, "..."), (-5, "ANDROID")], "id long, query string")
    q = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), F.col("text").alias("query")).unionByName(said)
    return q.select("id", lx.is_only_operators(F.col("query")).alias("only_operators"))


@reg("b13_page_listing_by_collection", "SELECT slug, page_type FROM mem_pages WHERE collection_id = 1 AND namespace_id IN ('team-orchard', '') ORDER BY updated_at DESC, slug LIMIT 1000")
def b13(spark, d):
    p = sc.apply_scope(table(spark, d, "mem_pages"), collection_id=1, namespace="team-orchard", include_superseded=True, include_quarantined=True)
    return p.orderBy(F.col("updated_at").desc(), "slug").limit(1000).select("slug", "page_type")


@reg("f03_exact_depth", f"""SELECT query_id, id, round(s, 6) AS score, rn AS rank FROM (
  SELECT q.vec_id AS query_id, r.vec_id AS id, {sq._COS.format('q.embedding', 'r.embedding')} AS s,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY round({sq._COS.format('q.embedding', 'r.embedding')}, 12) DESC, r.vec_id) AS rn
  FROM embeddings q, embeddings r WHERE q.vec_id % 50 = 0) WHERE rn <= 200""", longs=("rank",))
def f03(spark, d):
    """The neighbours at a depth of 200, beyond any candidate list."""
    e = table(spark, d, "embeddings")
    return ve.knn(e, e.where("vec_id % 50 = 0"), 200).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@reg("g03_quality_passes", f"SELECT slug, score FROM ({sq.SQL['g02_union_fusion']}) WHERE score >= 0.35 ORDER BY score DESC, slug LIMIT 25")
def g03(spark, d):
    return sc.floor(sq.g02(spark, d), 0.35).orderBy(F.col("score").desc(), "slug").limit(25)


_ONE_HOP = f"""
WITH seeds AS (SELECT p.page_id, s.slug, s.score FROM ({sq.SQL['g01_hybrid_search']}) s JOIN mem_pages p USING (slug)),
h AS (SELECT l.to_page_id AS page_id, max(s.score * l.edge_weight * 0.5) AS score FROM (SELECT DISTINCT * FROM links) l JOIN seeds s ON s.page_id = l.from_page_id JOIN mem_pages t ON t.page_id = l.to_page_id
  WHERE t.superseded_by IS NULL AND t.quarantined_at IS NULL AND (l.valid_from IS NULL OR l.valid_from <= '{sq.DAY}') AND (l.valid_until IS NULL OR l.valid_until >= '{sq.DAY}') AND l.to_page_id NOT IN (SELECT page_id FROM seeds) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50)
SELECT page_id, round(score, 9) AS score FROM (SELECT page_id, score FROM seeds UNION ALL SELECT page_id, score FROM h)"""


@reg("g04_search_with_hops", _ONE_HOP)
def g04(spark, d):
    seeds = sq.g01(spark, d).join(table(spark, d, "mem_pages").select("slug", "page_id"), "slug").select("page_id", "score")
    more = gr.expand(seeds, tq.links(spark, d), table(spark, d, "mem_pages"), sq.DAY, 1)
    return seeds.unionByName(more.select("page_id", "score")).select("page_id", F.round("score", 9).alias("score"))


@reg("h15_search_pipeline", f"SELECT slug, tier FROM (SELECT t.slug, t.tier, p.wing FROM ({sq.SQL['h05_tiered_search']}) t JOIN mem_pages p USING (page_id)) WHERE wing = 'projects'")
def h15(spark, d):
    hits = sq.h05(spark, d).join(table(spark, d, "mem_pages").select("page_id", "wing"), "page_id")
    return hits.where("wing = 'projects'").select("slug", "tier")


@reg("i15_replace_vectors", "SELECT vec_id, label FROM embeddings WHERE vec_id % 5 <> 0 UNION ALL SELECT vec_id, label + 100 FROM embeddings WHERE vec_id % 10 = 0")
def i15(spark, d):
    """Vectors of the pages divisible by 5 go; new ones come for those divisible by 10."""
    e = table(spark, d, "embeddings").select("vec_id", "label")
    new = e.where("vec_id % 10 = 0").withColumn("label", F.col("label") + 100)
    return sy.replace_rows(e, e.where("vec_id % 5 = 0"), new, "vec_id")


@reg("i17_pages_to_embed", "SELECT page_id FROM mem_pages WHERE quarantined_at IS NULL AND (page_id NOT IN (SELECT vec_id FROM embeddings) OR updated_at > created_at + INTERVAL 30 DAY)")
def i17(spark, d):
    p = table(spark, d, "mem_pages").where("quarantined_at is null")
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("page_id"), F.lit(True).alias("has"))
    late = F.col("updated_at") > F.col("created_at") + F.expr("INTERVAL 30 DAY")
    return p.join(e, "page_id", "left").where(F.col("has").isNull() | late).select("page_id")


@reg("i20_evidence_kind", "SELECT assertion_id, source_ref, CASE WHEN source_ref IS NULL OR source_ref = '' THEN 'stand-in' ELSE 'model' END AS evidence, CASE WHEN source_ref IS NULL OR source_ref = '' THEN 'refused' ELSE 'allowed' END AS may_supersede FROM assertions")
def i20(spark, d):
    kind, may = ve.evidence(F.nullif("source_ref", F.lit("")))
    return table(spark, d, "assertions").select("assertion_id", "source_ref", kind.alias("evidence"), may.alias("may_supersede"))


@reg("j09_frontmatter_edge_sync", "SELECT DISTINCT l.link_id, CASE WHEN p.page_id IS NULL THEN 'unresolved' WHEN p.collection_id <> s.collection_id THEN 'other collection' ELSE 'kept' END AS outcome FROM links l JOIN mem_pages s ON s.page_id = l.from_page_id LEFT JOIN mem_pages p ON p.page_id = l.to_page_id AND p.quarantined_at IS NULL WHERE l.source_kind = 'frontmatter'")
def j09(spark, d):
    return gr.edge_outcomes(tq.links(spark, d).where("source_kind = 'frontmatter'"), table(spark, d, "mem_pages")).select("link_id", "outcome")


@reg("j13_tolerant_fields", "SELECT page_id, json_valid(frontmatter) AND frontmatter <> '' AS readable FROM mem_pages WHERE frontmatter IS NOT NULL")
def j13(spark, d):
    p = table(spark, d, "mem_pages").where("frontmatter is not null")
    return p.select("page_id", (F.try_parse_json("frontmatter").isNotNull() & (F.col("frontmatter") != "")).alias("readable"))


@reg("j14_supersede_chain", "SELECT DISTINCT ON (superseded_by) superseded_by AS head, page_id AS predecessor FROM mem_pages WHERE superseded_by IS NOT NULL ORDER BY superseded_by, updated_at DESC, page_id DESC")
def j14(spark, d):
    """One predecessor per head, the one changed last."""
    old = table(spark, d, "mem_pages").where("superseded_by is not null")
    one = sy.latest(old, ["superseded_by"], F.col("updated_at").desc(), F.col("page_id").desc())
    return one.select(F.col("superseded_by").alias("head"), F.col("page_id").alias("predecessor"))


_SUCC = "SELECT a.page_id, min(b.page_id) AS new_id FROM mem_pages a JOIN mem_pages b ON b.title = a.title AND b.collection_id = a.collection_id AND b.page_id > a.page_id AND b.superseded_by IS NULL GROUP BY 1"


@reg("j16_mark_superseded", f"WITH s AS ({_SUCC}) SELECT a.page_id, coalesce(a.superseded_by, s.new_id) AS superseded_by FROM mem_pages a LEFT JOIN s USING (page_id)")
def j16(spark, d):
    """Pages of one title: the next live one of the collection takes over."""
    p = table(spark, d, "mem_pages")
    a = p.select("page_id", "collection_id", "title")
    b = p.where("superseded_by is null").select(F.col("page_id").alias("new_id"), "collection_id", "title")
    s = a.join(b, ["collection_id", "title"]).where("new_id > page_id").groupBy("page_id").agg(F.min("new_id").alias("new_id"))
    return gr.mark_superseded(p, s).select("page_id", "superseded_by")


@reg("k44_rehydrate_marks", "SELECT gap_id, len(regexp_extract_all(redacted_query, '<[A-Z]+_[0-9]+>')) AS marks FROM (SELECT DISTINCT gap_id, redacted_query FROM knowledge_gaps) WHERE redacted_query IS NOT NULL", longs=('marks',))
def k44(spark, d):
    g = table(spark, d, "knowledge_gaps").where("redacted_query is not null").select("gap_id", "redacted_query").distinct()
    return g.select("gap_id", F.size(F.regexp_extract_all("redacted_query", F.lit("<[A-Z]+_[0-9]+>"), F.lit(0))).alias("marks"))


@reg("k47_fact_validation", "SELECT DISTINCT assertion_id, CASE WHEN trim(coalesce(subject, '')) = '' THEN 'about' WHEN trim(coalesce(evidence_text, '')) = '' THEN 'summary' END AS missing FROM assertions")
def k47(spark, d):
    missing = hg.missing_field({"about": F.col("subject"), "summary": F.col("evidence_text")})
    return table(spark, d, "assertions").select("assertion_id", missing.alias("missing")).distinct()


@reg("l02_head_selection", "WITH k AS (SELECT page_id, lower(trim(predicate)) AS predicate, assertion_id, row_number() OVER (PARTITION BY page_id, lower(trim(predicate)) ORDER BY assertion_id DESC) AS rn FROM (SELECT DISTINCT page_id, predicate, assertion_id FROM assertions)) SELECT page_id, predicate, assertion_id AS head FROM k WHERE rn = 1")
def l02(spark, d):
    a = table(spark, d, "assertions").select("page_id", F.lower(F.trim("predicate")).alias("predicate"), "assertion_id")
    return sy.newest(a, ["page_id", "predicate"], "assertion_id", "assertion_id").withColumnRenamed("assertion_id", "head")


@reg("l05_route_matches", "SELECT lower(trim(subject)) AS subject, lower(trim(predicate)) AS predicate, object_text, max(confidence) AS confidence, min(assertion_id) AS assertion_id FROM assertions GROUP BY 1, 2, 3")
def l05(spark, d):
    """Matches of one triple folded into one, with the best confidence."""
    return hg.route_matches(table(spark, d, "assertions"), ["subject", "predicate", "object_text"], "assertion_id", "confidence")


@reg("l06_entity_backfill", "SELECT predicate, count(*) AS matches, count(DISTINCT subject) AS subjects FROM (" + __import__("sedimenta.plans.scalar_queries", fromlist=["SQL"]).SQL["k18_entity_patterns"] + ") GROUP BY 1")
def l06(spark, d):
    from . import scalar_queries as sc_q

    return sc_q.k18(spark, d).groupBy("predicate").agg(F.count("*").alias("matches"), F.countDistinct("subject").alias("subjects"))


@reg("l12_resolve_gaps", f"SELECT DISTINCT gap_id, strftime(CASE WHEN redacted_query IS NOT NULL AND resolved_at IS NULL THEN TIMESTAMP '{NOW}' ELSE resolved_at END, '%Y-%m-%d %H:%M:%S') AS resolved_at FROM knowledge_gaps")
def l12(spark, d):
    g = hg.resolve_gaps(table(spark, d, "knowledge_gaps"), F.col("redacted_query").isNotNull(), now())
    return g.select("gap_id", F.date_format("resolved_at", "yyyy-MM-dd HH:mm:ss").alias("resolved_at")).distinct()


@reg("l14_namespace_upsert", "SELECT namespace_id, coalesce(CASE WHEN namespace_id LIKE 'team-%' THEN 48.0::DOUBLE END, ttl_hours) AS ttl_hours FROM page_namespaces UNION ALL SELECT 'new-one', 1.0::DOUBLE")
def l14(spark, d):
    n = table(spark, d, "page_namespaces").select("namespace_id", "ttl_hours")
    ch = n.where("namespace_id like 'team-%'").withColumn("ttl_hours", F.lit(48.0))
    return sy.put_all(n, ch.unionByName(spark.createDataFrame([("new-one", 1.0)], "namespace_id string, ttl_hours double")), ["namespace_id"])


@reg("l21_quarantine_sweep", f"""
SELECT page_id FROM mem_pages WHERE quarantined_at IS NOT NULL AND date_sub('second', quarantined_at, TIMESTAMP '{NOW}') >= 30 * 86400
 AND page_id NOT IN (SELECT page_id FROM assertions WHERE asserted_by <> 'import') AND page_id NOT IN (SELECT from_page_id FROM links WHERE source_kind = 'programmatic')""")  # fmt: skip
def l21(spark, d):
    return hg.sweep(table(spark, d, "mem_pages"), "quarantined_at", now(), 30 * 86400, _held(spark, d), "page_id").select("page_id")


def _held(spark, d):
    """Pages that only the database knows something of."""
    a = table(spark, d, "assertions").where("asserted_by <> 'import'").select("page_id")
    return a.unionByName(table(spark, d, "links").where("source_kind = 'programmatic'").select(F.col("from_page_id").alias("page_id")))


_PLAN = tq.SQL["c24_rename_cascade"]


@reg("l23_reconcile_plan", f"WITH r AS ({_PLAN}), f AS ({tq.SQL['c20_file_diff']}) SELECT rel_path, CASE WHEN change = 'missing' THEN 0 WHEN change = 'modified' THEN 2 ELSE 3 END AS step, change AS action FROM f WHERE change <> 'unchanged' AND rel_path NOT IN (SELECT from_path FROM r) AND rel_path NOT IN (SELECT to_path FROM r) UNION ALL SELECT to_path, 1, 'rename' FROM r")
def l23(spark, d):
    """What to do with every file, in order of the steps: missing, renamed, modified, new."""
    r = tq.c24(spark, d)
    f = tq.c20(spark, d).where("change <> 'unchanged'")
    for side in ("from_path", "to_path"):
        f = f.join(r.select(F.col(side).alias("rel_path")), "rel_path", "left_anti")
    step = F.when(F.col("change") == "missing", 0).when(F.col("change") == "modified", 2).otherwise(3)
    return f.select("rel_path", step.alias("step"), F.col("change").alias("action")).unionByName(r.select(F.col("to_path").alias("rel_path"), F.lit(1).alias("step"), F.lit("rename").alias("action")))


@reg("m22_incremental_reconcile", f"SELECT action, count(*) AS n FROM ({reg.sql['l23_reconcile_plan']}) GROUP BY 1")
def m22(spark, d):
    return l23(spark, d).groupBy("action").agg(F.count("*").alias("n"))


@reg("l24_file_state", "SELECT collection_id, rel_path, max_by(doc_id, (ingested_at, doc_id)) AS doc_id FROM documents GROUP BY 1, 2")
def l24(spark, d):
    return sy.newest(table(spark, d, "documents"), ["collection_id", "rel_path"], "doc_id", "ingested_at", "doc_id")


@reg("m02_session_cursor", "SELECT user_id, count(*) AS max_ordinal, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_at FROM events GROUP BY 1")
def m02(spark, d):
    c = cv.cursors(table(spark, d, "events"), "user_id", "ts")
    return c.withColumn("last_at", F.date_format("last_at", "yyyy-MM-dd HH:mm:ss"))


@reg("m11_expired_leases", "SELECT event_id, CASE WHEN value >= 300 / 4.0 THEN 'failed' ELSE 'pending' END AS state FROM events WHERE ts <= (SELECT max(ts) FROM events) - INTERVAL 300 SECOND")
def m11(spark, d):
    e = table(spark, d, "events")
    last = F.lit(str(e.agg(F.max("ts").alias("t")).first()["t"])).cast("timestamp_ntz")
    return sy.leases(e, "ts", last, 300, F.col("value") >= 75.0).select("event_id", "state")


@reg("m13_janitor", "SELECT event_type, count(*) AS kept FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 30 DAY GROUP BY 1")
def m13(spark, d):
    e = table(spark, d, "events")
    last = F.lit(str(e.agg(F.max("ts").alias("t")).first()["t"])).cast("timestamp_ntz")
    return sy.kept_days(e, "ts", last, 30).groupBy("event_type").agg(F.count("*").alias("kept"))


@reg("m15_claim_jobs", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, ts, event_id) AS rn FROM events WHERE value > 10) WHERE rn <= 4")
def m15(spark, d):
    return sy.claim(table(spark, d, "events").where("value > 10"), ["user_id"], 4, F.col("value").desc(), F.col("ts"), F.col("event_id")).select("event_id")


@reg("m19_path_batches", "SELECT user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, count(DISTINCT event_type) AS paths FROM events GROUP BY 1, 2")
def m19(spark, d):
    return sy.batches(table(spark, d, "events"), ["user_id"], "ts", 3600, "event_type").withColumnRenamed("batch", "hour")


@reg("m12_complete_jobs", """WITH j AS (SELECT event_id AS job_id, event_id % 4 AS attempts, CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN 'done' ELSE 'running' END AS state, value FROM events)
SELECT job_id, CASE WHEN state <> 'running' OR user_odd THEN state WHEN value > 20 THEN 'done' WHEN attempts >= 3 THEN 'failed' ELSE 'pending' END AS state FROM (SELECT *, floor(value) % 2 = 1 AS user_odd FROM j)""")
def m12(spark, d):
    """Reports count if the job runs and the attempt is the one seen; reports of an older attempt (odd values) are refused."""
    e = table(spark, d, "events")
    first = e.agg(F.min("event_type")).first()[0]
    jobs = e.select(F.col("event_id").alias("job_id"), (F.col("event_id") % 4).alias("attempts"), F.when(F.col("event_type") == first, "done").otherwise("running").alias("state"))
    reports = e.select(F.col("event_id").alias("job_id"), (F.col("event_id") % 4 - F.floor("value") % 2).alias("attempts"), (F.col("value") > 20).alias("ok"))
    return sy.complete(jobs, reports, 3)[0].select("job_id", "state")


@reg("m18_orphan_jobs", "SELECT event_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def m18(spark, d):
    owners = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    return sy.orphans(table(spark, d, "events"), owners, "user_id").select("event_id")


@reg("m23_hash_audit", "SELECT d.doc_id, CASE WHEN d.doc_id % 7 = 0 THEN 'missing' WHEN d.doc_id % 5 = 0 AND text IS NOT NULL AND text <> '' THEN 'changed' ELSE 'intact' END AS verdict FROM documents d")
def m23(spark, d):
    """Every stored text's digest against that of what is found: some files are gone, some have lost their last character."""
    t = table(spark, d, "documents")
    stored = t.select("doc_id", F.sha2("text", 256).alias("sha256"))
    cut = F.when(F.col("doc_id") % 5 == 0, F.expr("substring(text, 1, length(text) - 1)")).otherwise(F.col("text"))
    found = t.where("doc_id % 7 <> 0").select("doc_id", F.sha2(cut, 256).alias("sha256"))
    return sy.audit(stored, found, "doc_id", "sha256")


@reg("m03_closed_sessions", f"""SELECT user_id, session_no, CASE WHEN date_diff('second', CAST(ended AS TIMESTAMP), (SELECT max(ts) FROM events)) >= 86400 THEN strftime(ended, '%Y-%m-%d %H:%M:%S') END AS closed_at FROM (
WITH g AS (SELECT user_id, event_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR date_diff('microsecond', lag(ts) OVER w, ts) >= 43200000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session_no FROM g) SELECT user_id, CAST(session_no AS BIGINT) AS session_no, max(ts) AS ended FROM s GROUP BY 1, 2)""")
def m03(spark, d):
    e = table(spark, d, "events")
    last = F.lit(str(e.agg(F.max("ts").alias("t")).first()["t"])).cast("timestamp_ntz")
    s = cv.close_sessions(cv.idle_sessions(e, "user_id", "ts", 12 * 3600), last, 86400)
    return s.select("user_id", "session_no", F.date_format("closed_at", "yyyy-MM-dd HH:mm:ss").alias("closed_at"))


@reg("l07_resolved_contradictions", f"""WITH c AS (SELECT assertion_id, coalesce(max(confidence), 0) AS c FROM assertions GROUP BY 1)
SELECT p.low, p.high, CASE WHEN a.c > b.c THEN p.low ELSE p.high END AS kept, CASE WHEN a.c > b.c THEN p.high ELSE p.low END AS closed FROM (SELECT DISTINCT low, high FROM ({tq.SQL['c09_contradictions']})) p JOIN c a ON a.assertion_id = p.low JOIN c b ON b.assertion_id = p.high""")
def l07(spark, d):
    a = table(spark, d, "assertions")
    return hg.resolve_contradictions(hg.contradictions(a).select("low", "high").distinct(), a, "2025-01-01")[0]


@reg("l25_restored_pages", "SELECT page_id, quarantined_at IS NOT NULL AND page_id % 2 = 0 AS quarantined FROM mem_pages")
def l25(spark, d):
    """Pages with odd ids come back from quarantine: every slug is unique, so no place is taken."""
    p = table(spark, d, "mem_pages")
    back, _ = hg.restore(p, p.where("page_id % 2 = 1").select("page_id"), ["collection_id", "namespace_id", "slug"])
    return back.select("page_id", F.col("quarantined_at").isNotNull().alias("quarantined"))


@reg("n19_mmr")
def n19(spark, d):
    """A diverse top ten out of the fifty best by cosine to vector 0 (a top-k list on the driver)."""
    e = table(spark, d, "embeddings")
    best = ve.score_against(e, list(e.where("vec_id = 0").first()["embedding"])).orderBy(F.col("score").desc(), "vec_id").limit(50).collect()
    picked = hy.mmr([(r["vec_id"], r["score"], r["embedding"]) for r in best], 0.7, 10)
    return spark.createDataFrame([(i, int(v)) for i, v in enumerate(picked)], "place int, vec_id long")


@reg("d02_contradictions_by_predicate", f"SELECT predicate, count(*) AS n FROM ({tq.SQL['c09_contradictions']}) GROUP BY 1")
def d02b(spark, d):
    return hg.contradictions(table(spark, d, "assertions")).groupBy("predicate").agg(F.count("*").alias("n"))


@reg("k05_slug_of_source", "SELECT doc_id, coalesce(source, '') || '/' || regexp_replace(regexp_replace(lower(coalesce(doc_kind, '')), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM documents")
def k05b(spark, d):
    return table(spark, d, "documents").select("doc_id", F.concat(F.coalesce("source", F.lit("")), F.lit("/"), tx.slugify(F.coalesce("doc_kind", F.lit("")))).alias("slug"))


QUERIES, SQL = reg.queries, reg.sql
