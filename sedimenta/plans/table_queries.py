"""Queries of joins, aggregates, ordering, set operations, hygiene, sync and conversation operators, with SQL twins."""

from __future__ import annotations

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import conversation as cv
from ..operators import graph as gr
from ..operators import hygiene as hg
from ..operators import sync as sy
from ..operators import vector as ve
from ..operators.scope import active_on
from ..sources.tables import table
from .registry import Registry

reg = Registry()
DAY, NOW = "2020-06-30", "2025-06-01 00:00:00"
_ACTIVE = f"(valid_from IS NULL OR valid_from <= '{DAY}') AND (valid_until IS NULL OR valid_until >= '{DAY}')"


def pages(spark: SparkSession, d: str):
    return table(spark, d, "mem_pages")


def links(spark: SparkSession, d: str):
    """Rows delivered twice count once."""
    return table(spark, d, "links").dropDuplicates(["link_id"])


def now():
    return F.expr(f"TIMESTAMP_NTZ '{NOW}'")


# --- joins -------------------------------------------------------------------------------------------------------------------


@reg("c01_chunk_page", "SELECT p.page_id, e.vec_id, e.label FROM embeddings e JOIN mem_pages p ON p.page_id = e.vec_id WHERE p.quarantined_at IS NULL")
def c01(spark, d):
    p = pages(spark, d).where("quarantined_at is null").select("page_id")
    return table(spark, d, "embeddings").join(p, F.col("vec_id") == F.col("page_id")).select("page_id", "vec_id", "label")


@reg("c02_page_collection", "SELECT page_id, coll_name || '::' || slug AS canonical, coll_state FROM mem_pages JOIN collections USING (collection_id) WHERE quarantined_at IS NULL")
def c02(spark, d):
    p = pages(spark, d).where("quarantined_at is null")
    return p.join(table(spark, d, "collections"), "collection_id").select("page_id", F.concat("coll_name", F.lit("::"), "slug").alias("canonical"), "coll_state")


@reg("c03_edges_to_live_pages", f"SELECT l.link_id, a.slug AS from_slug, b.slug AS to_slug, l.relationship FROM (SELECT DISTINCT * FROM links) l JOIN mem_pages a ON a.page_id = l.from_page_id JOIN mem_pages b ON b.page_id = l.to_page_id WHERE b.superseded_by IS NULL AND b.quarantined_at IS NULL AND {_ACTIVE}")
def c03(spark, d):
    p = pages(spark, d)
    a = p.select(F.col("page_id").alias("from_page_id"), F.col("slug").alias("from_slug"))
    b = p.where("superseded_by is null and quarantined_at is null").select(F.col("page_id").alias("to_page_id"), F.col("slug").alias("to_slug"))
    return links(spark, d).where(active_on(DAY)).join(b, "to_page_id").join(a, "from_page_id").select("link_id", "from_slug", "to_slug", "relationship")


@reg("c04_namespace_neighbours", """
WITH s AS (SELECT page_id, slug FROM mem_pages WHERE namespace_id = 'team-orchard' UNION ALL SELECT g.page_id, g.slug FROM mem_pages g WHERE g.namespace_id = '' AND NOT EXISTS (SELECT 1 FROM mem_pages x WHERE x.namespace_id = 'team-orchard' AND x.slug = g.slug))
SELECT DISTINCT l.link_id, s.slug AS from_slug, t.slug AS to_slug FROM links l JOIN s ON s.page_id = l.from_page_id JOIN mem_pages t ON t.page_id = l.to_page_id WHERE t.namespace_id IN ('team-orchard', '')""")  # fmt: skip
def c04(spark, d):
    p = pages(spark, d)
    own = p.where("namespace_id = 'team-orchard'").select("page_id", "slug")
    source = own.unionByName(p.where("namespace_id = ''").select("page_id", "slug").join(own.select("slug"), "slug", "left_anti"))
    s = source.select(F.col("page_id").alias("from_page_id"), F.col("slug").alias("from_slug"))
    t = p.where("namespace_id in ('team-orchard', '')").select(F.col("page_id").alias("to_page_id"), F.col("slug").alias("to_slug"))
    return links(spark, d).join(s, "from_page_id").join(t, "to_page_id").select("link_id", "from_slug", "to_slug")


@reg("c05_backlinks", f"SELECT to_page_id, link_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY to_page_id ORDER BY created_at DESC, link_id) AS rn FROM (SELECT DISTINCT * FROM links WHERE {_ACTIVE})) WHERE rn <= 100", longs=('rn',))
def c05(spark, d):
    """The newest hundred active links into every page."""
    w = Window.partitionBy("to_page_id").orderBy(F.col("created_at").desc(), "link_id")
    return links(spark, d).where(active_on(DAY)).withColumn("rn", F.row_number().over(w)).where("rn <= 100").select("to_page_id", "link_id", "rn")


@reg("c06_outbound_links", "SELECT DISTINCT l.link_id, a.slug AS from_slug, b.slug AS to_slug, l.relationship FROM links l JOIN mem_pages a ON a.page_id = l.from_page_id JOIN mem_pages b ON b.page_id = l.to_page_id WHERE l.from_page_id % 50 = 0")
def c06(spark, d):
    """All links, past ones too, out of the pages whose id is divisible by 50."""
    p = pages(spark, d)
    a, b = (p.select(F.col("page_id").alias(f"{x}_page_id"), F.col("slug").alias(f"{x}_slug")) for x in ("from", "to"))
    return links(spark, d).where("from_page_id % 50 = 0").join(a, "from_page_id").join(b, "to_page_id").select("link_id", "from_slug", "to_slug", "relationship")


@reg("c07_inbound_links", "SELECT DISTINCT l.link_id, a.slug AS from_slug, l.relationship FROM links l JOIN mem_pages a ON a.page_id = l.from_page_id WHERE l.to_page_id % 50 = 0")
def c07(spark, d):
    a = pages(spark, d).select(F.col("page_id").alias("from_page_id"), F.col("slug").alias("from_slug"))
    return links(spark, d).where("to_page_id % 50 = 0").join(a, "from_page_id").select("link_id", "from_slug", "relationship")


@reg("c06_all_outbound_links", "SELECT DISTINCT l.link_id, a.slug AS from_slug, b.slug AS to_slug, l.relationship FROM links l JOIN mem_pages a ON a.page_id = l.from_page_id JOIN mem_pages b ON b.page_id = l.to_page_id")
def c06_all(spark, d):
    """All links, past ones too, out of every page."""
    p = pages(spark, d)
    a, b = (p.select(F.col("page_id").alias(f"{x}_page_id"), F.col("slug").alias(f"{x}_slug")) for x in ("from", "to"))
    return links(spark, d).join(a, "from_page_id").join(b, "to_page_id").select("link_id", "from_slug", "to_slug", "relationship")


@reg("c07_all_inbound_links", "SELECT DISTINCT l.link_id, a.slug AS from_slug, l.relationship FROM links l JOIN mem_pages a ON a.page_id = l.from_page_id WHERE l.to_page_id IS NOT NULL")
def c07_all(spark, d):
    a = pages(spark, d).select(F.col("page_id").alias("from_page_id"), F.col("slug").alias("from_slug"))
    return links(spark, d).where("to_page_id is not null").join(a, "from_page_id").select("link_id", "from_slug", "relationship")


_CONTRA = """
one AS (SELECT DISTINCT assertion_id, page_id, lower(regexp_replace(subject, '^\\s+|\\s+$', '', 'g')) AS subject, lower(regexp_replace(predicate, '^\\s+|\\s+$', '', 'g')) AS predicate, object_text, valid_from, valid_until FROM assertions),
con AS (SELECT a.assertion_id AS low, b.assertion_id AS high, a.subject, a.predicate, a.object_text AS x, b.object_text AS y, a.page_id AS pa, b.page_id AS pb FROM one a JOIN one b ON a.subject = b.subject AND a.predicate = b.predicate AND a.assertion_id < b.assertion_id AND a.object_text <> b.object_text
 AND coalesce(a.valid_from, '') <= coalesce(b.valid_until, '9999-12-31T23:59:59Z') AND coalesce(b.valid_from, '') <= coalesce(a.valid_until, '9999-12-31T23:59:59Z'))"""


@reg("c09_contradictions", f"WITH {_CONTRA} SELECT low, high, subject, predicate, subject || ' has conflicting ' || predicate || ' assertions: ' || least(x, y) || ' vs ' || greatest(x, y) AS description FROM con")
def c09(spark, d):
    return hg.contradictions(table(spark, d, "assertions"))


@reg("c08_contradiction_pages", f"WITH {_CONTRA} SELECT low, high, p.slug, coalesce(q.slug, '') AS other_slug FROM con JOIN mem_pages p ON p.page_id = pa LEFT JOIN mem_pages q ON q.page_id = pb")
def c08(spark, d):
    a = table(spark, d, "assertions").select("assertion_id", "page_id").distinct()
    p = pages(spark, d).select("page_id", "slug")
    named = a.join(p, "page_id", "left").select("assertion_id", "slug")
    c = hg.contradictions(table(spark, d, "assertions")).select("low", "high")
    c = c.join(named.where("slug is not null").withColumnRenamed("assertion_id", "low"), "low")
    return c.join(named.select(F.col("assertion_id").alias("high"), F.col("slug").alias("other")), "high", "left").select("low", "high", "slug", F.coalesce("other", F.lit("")).alias("other_slug"))


@reg("c10_validity_overlap", "WITH one AS (SELECT DISTINCT assertion_id, page_id, predicate, valid_from, valid_until FROM assertions) SELECT a.assertion_id AS low, b.assertion_id AS high FROM one a JOIN one b ON a.page_id = b.page_id AND a.predicate = b.predicate AND a.assertion_id < b.assertion_id AND coalesce(a.valid_from, '') <= coalesce(b.valid_until, '9999-12-31T23:59:59Z') AND coalesce(b.valid_from, '') <= coalesce(a.valid_until, '9999-12-31T23:59:59Z')")
def c10(spark, d):
    one = table(spark, d, "assertions").select("assertion_id", "page_id", "predicate", "valid_from", "valid_until").distinct()
    same = F.expr("a.page_id = b.page_id and a.predicate = b.predicate and a.assertion_id < b.assertion_id")
    return one.alias("a").join(one.alias("b"), same & hg.windows_overlap("a", "b")).select(F.col("a.assertion_id").alias("low"), F.col("b.assertion_id").alias("high"))


@reg("c11_overlapping_links", "WITH o AS (SELECT DISTINCT link_id, from_page_id, to_page_id, relationship, valid_from, valid_until FROM links) SELECT a.link_id AS low, b.link_id AS high FROM o a JOIN o b ON a.from_page_id = b.from_page_id AND a.to_page_id = b.to_page_id AND a.relationship = b.relationship AND a.link_id < b.link_id AND coalesce(a.valid_from, '') < coalesce(b.valid_until, '9999-12-31') AND coalesce(b.valid_from, '') < coalesce(a.valid_until, '9999-12-31')")
def c11(spark, d):
    return hg.overlapping_links(table(spark, d, "links"))


_AGAIN = "SELECT assertion_id, subject, predicate, object_text, valid_from, valid_until FROM assertions UNION ALL SELECT assertion_id + 1000000, subject, predicate, object_text, valid_from, valid_until FROM assertions WHERE confidence > 0.8"


@reg("c12_duplicate_assertions", f"WITH x AS ({_AGAIN}), o AS (SELECT DISTINCT assertion_id, subject, predicate, object_text, valid_from, valid_until FROM x) SELECT a.assertion_id AS low, b.assertion_id AS high FROM o a JOIN o b ON a.subject = b.subject AND a.predicate = b.predicate AND a.object_text = b.object_text AND a.assertion_id < b.assertion_id AND coalesce(a.valid_from, '') < coalesce(b.valid_until, '9999-12-31') AND coalesce(b.valid_from, '') < coalesce(a.valid_until, '9999-12-31')")
def c12(spark, d):
    """The table has no duplicates of its own; confident assertions are said a second time under other ids."""
    a = table(spark, d, "assertions").select("assertion_id", "subject", "predicate", "object_text", "valid_from", "valid_until", "confidence")
    again = a.where("confidence > 0.8").withColumn("assertion_id", F.col("assertion_id") + 1000000)
    return hg.duplicate_assertions(a.unionByName(again))


@reg("c13_dangling_links", "SELECT DISTINCT link_id, 'from' AS side FROM links WHERE from_page_id NOT IN (SELECT page_id FROM mem_pages WHERE quarantined_at IS NULL) UNION ALL SELECT DISTINCT link_id, 'to' FROM links WHERE to_page_id NOT IN (SELECT page_id FROM mem_pages WHERE quarantined_at IS NULL)")
def c13(spark, d):
    live = pages(spark, d).where("quarantined_at is null")
    parts = [hg.dangling(links(spark, d), f"{s}_page_id", live).select("link_id", F.lit(s).alias("side")) for s in ("from", "to")]
    return parts[0].unionByName(parts[1])


@reg("c14_dangling_assertions", "SELECT DISTINCT assertion_id, 'page' AS side FROM assertions WHERE page_id NOT IN (SELECT page_id FROM mem_pages WHERE superseded_by IS NULL) UNION ALL SELECT DISTINCT assertion_id, 'supersedes' FROM assertions WHERE supersedes_id IS NOT NULL AND supersedes_id NOT IN (SELECT assertion_id FROM assertions WHERE confidence > 0.5)")
def c14(spark, d):
    a = table(spark, d, "assertions").dropDuplicates(["assertion_id"])
    p = hg.dangling(a, "page_id", pages(spark, d).where("superseded_by is null")).select("assertion_id", F.lit("page").alias("side"))
    sure = a.where("confidence > 0.5").select("assertion_id")
    return p.unionByName(hg.dangling(a, "supersedes_id", sure, "assertion_id").select("assertion_id", F.lit("supersedes").alias("side")))


@reg("c15_pages_without_vector", "SELECT page_id FROM mem_pages WHERE page_id NOT IN (SELECT vec_id FROM embeddings)")
def c15(spark, d):
    return pages(spark, d).select("page_id").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("page_id")), "page_id", "left_anti")


@reg("c16_orphan_vectors", "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT page_id FROM mem_pages WHERE quarantined_at IS NULL)")
def c16(spark, d):
    p = pages(spark, d).where("quarantined_at is null").select(F.col("page_id").alias("vec_id"))
    return table(spark, d, "embeddings").select("vec_id").join(p, "vec_id", "left_anti")


@reg("c17_quarantine_exports", "SELECT p.page_id, g.gap_id FROM mem_pages p LEFT JOIN (SELECT DISTINCT gap_id, page_id, detected_at FROM knowledge_gaps) g ON g.page_id = p.page_id AND g.detected_at >= p.quarantined_at WHERE p.quarantined_at IS NOT NULL")
def c17(spark, d):
    p = pages(spark, d).where("quarantined_at is not null").alias("p")
    g = table(spark, d, "knowledge_gaps").select("gap_id", "page_id", "detected_at").distinct().alias("g")
    return p.join(g, F.expr("g.page_id = p.page_id and g.detected_at >= p.quarantined_at"), "left").select("p.page_id", "g.gap_id")


@reg("c18_slug_owner_names", "SELECT slug, coll_name FROM mem_pages JOIN collections USING (collection_id)")
def c18(spark, d):
    return pages(spark, d).join(table(spark, d, "collections"), "collection_id").select("slug", "coll_name")


@reg("c19_supersede_pairs", "SELECT a.page_id AS old_id, b.page_id AS new_id, b.slug AS new_slug FROM mem_pages a JOIN mem_pages b ON a.superseded_by = b.page_id")
def c19(spark, d):
    p = pages(spark, d)
    new = p.select(F.col("page_id").alias("new_id"), F.col("slug").alias("new_slug"))
    return p.where("superseded_by is not null").select(F.col("page_id").alias("old_id"), F.col("superseded_by").alias("new_id")).join(new, "new_id").select("old_id", "new_id", "new_slug")


@reg("e07_predecessors", "SELECT b.page_id, a.page_id AS predecessor FROM mem_pages b LEFT JOIN mem_pages a ON a.superseded_by = b.page_id WHERE b.superseded_by IS NULL")
def e07(spark, d):
    p = pages(spark, d)
    old = p.where("superseded_by is not null").select(F.col("superseded_by").alias("page_id"), F.col("page_id").alias("predecessor"))
    return p.where("superseded_by is null").select("page_id").join(old, "page_id", "left")


_STORED = "stored AS (SELECT doc_id, doc_id || '/' || rel_path AS rel_path, n_chars AS size, sha256(text) AS sha256, CASE WHEN doc_id % 5 = 0 THEN 'u' || doc_id END AS uuid FROM documents WHERE doc_id % 7 <> 0)"
_WALKED = "walked AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'moved/' ELSE '' END || doc_id || '/' || rel_path AS rel_path, n_chars + CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END AS size, sha256(text) AS sha256, CASE WHEN doc_id % 5 = 0 THEN 'u' || doc_id END AS uuid FROM documents WHERE doc_id % 11 <> 0)"


def _files(spark: SparkSession, d: str):
    """The stored state and a later walk of a vault, both derived from all documents by the same rules as the SQL."""
    t = table(spark, d, "documents")
    base = [F.sha2("text", 256).alias("sha256"), F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("u"), "doc_id")).alias("uuid")]
    path = F.concat("doc_id", F.lit("/"), "rel_path")
    stored = t.where("doc_id % 7 <> 0").select("doc_id", path.alias("rel_path"), F.col("n_chars").alias("size"), *base)
    moved = F.when(F.col("doc_id") % 17 == 0, "moved/").otherwise("")
    size = F.col("n_chars") + F.when(F.col("doc_id") % 13 == 0, 1).otherwise(0)
    walked = t.where("doc_id % 11 <> 0").select("doc_id", F.concat(moved, path).alias("rel_path"), size.alias("size"), *base)
    return stored, walked


@reg("c20_file_diff", f"WITH {_STORED}, {_WALKED} SELECT coalesce(s.rel_path, w.rel_path) AS rel_path, CASE WHEN s.rel_path IS NULL THEN 'new' WHEN w.rel_path IS NULL THEN 'missing' WHEN s.size IS NOT DISTINCT FROM w.size AND s.sha256 IS NOT DISTINCT FROM w.sha256 THEN 'unchanged' ELSE 'modified' END AS change FROM stored s FULL JOIN walked w ON s.rel_path = w.rel_path")
def c20(spark, d):
    return sy.file_diff(*_files(spark, d), ["size", "sha256"])


_MISSING = f"{_STORED}, {_WALKED}, missing AS (SELECT * FROM stored WHERE rel_path NOT IN (SELECT rel_path FROM walked)), fresh AS (SELECT * FROM walked WHERE rel_path NOT IN (SELECT rel_path FROM stored))"


def _moved(spark: SparkSession, d: str):
    stored, walked = _files(spark, d)
    return stored.join(walked.select("rel_path"), "rel_path", "left_anti"), walked.join(stored.select("rel_path"), "rel_path", "left_anti")


def _once(table_: str, by: str, where: str = "TRUE") -> str:
    return f"(SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY {by}) AS n FROM {table_} WHERE {by} IS NOT NULL AND {where}) WHERE n = 1)"


@reg("c22_rename_by_uuid", f"WITH {_MISSING} SELECT m.rel_path AS from_path, f.rel_path AS to_path FROM {_once('missing', 'uuid')} m JOIN {_once('fresh', 'uuid')} f USING (uuid)")
def c22(spark, d):
    return sy.unique_matches(*_moved(spark, d), "uuid")


@reg("c23_rename_by_hash", f"WITH {_MISSING} SELECT m.rel_path AS from_path, f.rel_path AS to_path FROM {_once('missing', 'sha256', 'size >= 64')} m JOIN {_once('fresh', 'sha256', 'size >= 64')} f USING (sha256)")
def c23(spark, d):
    a, b = (x.where("size >= 64") for x in _moved(spark, d))
    return sy.unique_matches(a, b, "sha256")


_CASCADE = f"""WITH {_MISSING}, nat AS (SELECT m.rel_path AS from_path, f.rel_path AS to_path FROM missing m JOIN fresh f ON m.doc_id = f.doc_id WHERE m.doc_id % 2 = 0),
m2 AS (SELECT * FROM missing WHERE rel_path NOT IN (SELECT from_path FROM nat)), f2 AS (SELECT * FROM fresh WHERE rel_path NOT IN (SELECT to_path FROM nat)),
u AS (SELECT m.rel_path AS from_path, f.rel_path AS to_path FROM {_once('m2', 'uuid')} m JOIN {_once('f2', 'uuid')} f USING (uuid)),
m3 AS (SELECT * FROM m2 WHERE rel_path NOT IN (SELECT from_path FROM u)), f3 AS (SELECT * FROM f2 WHERE rel_path NOT IN (SELECT to_path FROM u)),
h AS (SELECT m.rel_path AS from_path, f.rel_path AS to_path FROM {_once('m3', 'sha256', 'size >= 64')} m JOIN {_once('f3', 'sha256', 'size >= 64')} f USING (sha256))
SELECT *, 'native' AS how FROM nat UNION ALL SELECT *, 'uuid' FROM u UNION ALL SELECT *, 'hash' FROM h"""


@reg("c24_rename_cascade", _CASCADE)
def c24(spark, d):
    a, b = _moved(spark, d)
    native = a.where("doc_id % 2 = 0").select("doc_id", F.col("rel_path").alias("from_path")).join(b.select("doc_id", F.col("rel_path").alias("to_path")), "doc_id").drop("doc_id")
    return sy.infer_renames(a, b, native)


@reg("c21_rename_native", f"WITH {_MISSING} SELECT m.rel_path AS from_path, f.rel_path AS to_path FROM missing m JOIN fresh f ON m.doc_id = f.doc_id WHERE m.doc_id % 2 = 0")
def c21(spark, d):
    return c24(spark, d).where("how = 'native'").select("from_path", "to_path")


@reg("c25_repeated_hashes", "SELECT doc_id FROM (SELECT doc_id, count(*) OVER (PARTITION BY sha256(text)) AS n FROM documents WHERE text IS NOT NULL) WHERE n > 1")
def c25(spark, d):
    return sy.repeated(table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h")), "h").select("doc_id")


@reg("c26_link_read_back", "SELECT DISTINCT l.link_id, ca.coll_name || '::' || a.slug AS from_slug, cb.coll_name || '::' || b.slug AS to_slug FROM links l JOIN mem_pages a ON a.page_id = l.from_page_id JOIN mem_pages b ON b.page_id = l.to_page_id JOIN collections ca ON ca.collection_id = a.collection_id JOIN collections cb ON cb.collection_id = b.collection_id")
def c26(spark, d):
    named = pages(spark, d).join(table(spark, d, "collections"), "collection_id").select("page_id", F.concat("coll_name", F.lit("::"), "slug").alias("c"))
    a, b = (named.select(F.col("page_id").alias(f"{x}_page_id"), F.col("c").alias(f"{x}_slug")) for x in ("from", "to"))
    return links(spark, d).join(a, "from_page_id").join(b, "to_page_id").select("link_id", "from_slug", "to_slug")


_SLUGGED = "regexp_replace(regexp_replace(replace(lower(regexp_replace(subject, '^\\s+|\\s+$', '', 'g')), ' ', '-'), '^/+|/+$', '', 'g'), '/+', '/', 'g')"


@reg("c27_entity_resolution", f"""
WITH s AS (SELECT DISTINCT subject, {_SLUGGED} AS sl FROM assertions WHERE subject IS NOT NULL),
t AS (SELECT lower(title) AS k, count(*) AS n, min(page_id) AS page_id FROM mem_pages WHERE title IS NOT NULL GROUP BY 1), b AS (SELECT split_part(slug, '/', -1) AS k, count(*) AS n, min(page_id) AS page_id FROM mem_pages GROUP BY 1),
e AS (SELECT slug, min(page_id) AS page_id FROM mem_pages GROUP BY 1)
SELECT s.subject, CASE WHEN e.page_id IS NOT NULL THEN e.page_id WHEN r.page_id IS NOT NULL THEN r.page_id WHEN t.n IS NOT NULL THEN CASE WHEN t.n = 1 THEN t.page_id END WHEN b.n = 1 THEN b.page_id END AS page_id
FROM s LEFT JOIN e ON e.slug = s.sl LEFT JOIN e r ON r.slug = 'people/' || s.sl LEFT JOIN t ON t.k = lower(regexp_replace(s.subject, '^\\s+|\\s+$', '', 'g')) LEFT JOIN b ON b.k = s.sl""")  # fmt: skip
def c27(spark, d):
    """A surface's page: exact slug, slug under its role, title, last part of a slug; the later two only if unique."""
    p = pages(spark, d)
    s = table(spark, d, "assertions").where("subject is not null").select("subject").distinct().withColumn("sl", tx.resolve_slug(F.col("subject"))).withColumn("low", F.lower(tx.strip(F.col("subject"))))
    e = p.groupBy("slug").agg(F.min("page_id").alias("id"))
    t = p.where("title is not null").groupBy(F.lower("title").alias("low")).agg(F.count("*").alias("tn"), F.min("page_id").alias("t"))
    b = p.groupBy(F.substring_index("slug", "/", -1).alias("sl")).agg(F.count("*").alias("bn"), F.min("page_id").alias("b"))
    out = s.join(e.select(F.col("slug").alias("sl"), F.col("id").alias("e")), "sl", "left").join(e.select(F.expr("substring(slug, 8)").alias("sl"), F.col("id").alias("r"), "slug").where("slug like 'people/%'").drop("slug"), "sl", "left")
    out = out.join(t, "low", "left").join(b, "sl", "left")
    page = F.when(F.col("e").isNotNull(), F.col("e")).when(F.col("r").isNotNull(), F.col("r")).when(F.col("tn").isNotNull(), F.when(F.col("tn") == 1, F.col("t"))).when(F.col("bn") == 1, F.col("b"))
    return out.select("subject", page.alias("page_id"))


@reg("c28_wikilink_targets", """
WITH w AS (SELECT page_id, collection_id, namespace_id, unnest(list_distinct(list_transform(regexp_extract_all(compiled_truth || ' ' || coalesce(timeline, ''), '\\[\\[([^\\[\\]]+)\\]\\]', 1), lambda x: regexp_replace(regexp_replace(replace(lower(regexp_replace(x, '^\\s+|\\s+$', '', 'g')), ' ', '-'), '^/+|/+$', '', 'g'), '/+', '/', 'g')))) AS slug FROM mem_pages WHERE compiled_truth IS NOT NULL)
SELECT w.page_id, w.slug, t.page_id AS target FROM w LEFT JOIN (SELECT slug, min(page_id) AS page_id FROM mem_pages GROUP BY 1) t ON t.slug = w.slug""")  # fmt: skip
def c28(spark, d):
    p = pages(spark, d)
    w = p.where("compiled_truth is not null").select("page_id", F.explode(F.array_distinct(tx.wikilinks(F.concat("compiled_truth", F.lit(" "), F.coalesce("timeline", F.lit("")))))).alias("slug"))
    return w.join(p.groupBy("slug").agg(F.min("page_id").alias("target")), "slug", "left").select("page_id", "slug", "target")


@reg("c29_remove_page_vectors", "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT page_id FROM mem_pages WHERE superseded_by IS NOT NULL)")
def c29(spark, d):
    gone = pages(spark, d).where("superseded_by is not null").select(F.col("page_id").alias("vec_id"))
    return table(spark, d, "embeddings").select("vec_id").join(gone, "vec_id", "left_anti")


# --- aggregates --------------------------------------------------------------------------------------------------------------


@reg("d02_pages_by_type", "SELECT lower(trim(page_type)) AS page_type, count(*) AS n FROM mem_pages GROUP BY 1 ORDER BY 1")
def d02(spark, d):
    return pages(spark, d).groupBy(F.lower(F.trim("page_type")).alias("page_type")).agg(F.count("*").alias("n")).orderBy("page_type")


_COUNTED = ("mem_pages", "links", "assertions", "knowledge_gaps", "embeddings", "collections")


@reg("d03_global_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _COUNTED))
def d03(spark, d):
    parts = [table(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in _COUNTED]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@reg("d04_collection_counts", "SELECT c.coll_name, (SELECT count(*) FROM mem_pages p WHERE p.collection_id = c.collection_id AND p.quarantined_at IS NULL) AS pages, (SELECT count(*) FROM mem_pages p WHERE p.collection_id = c.collection_id AND p.superseded_by IS NOT NULL) AS superseded FROM collections c WHERE c.root_path <> '' ORDER BY 1")
def d04(spark, d):
    n = pages(spark, d).groupBy("collection_id").agg(F.count_if(F.col("quarantined_at").isNull()).alias("pages"), F.count_if(F.col("superseded_by").isNotNull()).alias("superseded"))
    c = table(spark, d, "collections").where("root_path <> ''").join(n, "collection_id", "left")
    return c.select("coll_name", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("superseded", F.lit(0)).alias("superseded")).orderBy("coll_name")


@reg("d05_collection_freshness", f"SELECT coll_name, CASE WHEN last_sync_at IS NULL THEN 'never' WHEN date_sub('second', last_sync_at, TIMESTAMP '{NOW}') > 7 * 86400 THEN 'stale' ELSE 'fresh' END AS freshness FROM collections")
def d05(spark, d):
    age = F.timestamp_diff("SECOND", F.col("last_sync_at"), now())
    return table(spark, d, "collections").select("coll_name", F.when(F.col("last_sync_at").isNull(), "never").when(age > 7 * 86400, "stale").otherwise("fresh").alias("freshness"))


@reg("d06_vault_statistics", "SELECT (SELECT count(*) FROM mem_pages) AS pages, (SELECT count(DISTINCT link_id) FROM links) AS links, (SELECT count(DISTINCT gap_id) FROM knowledge_gaps WHERE resolved_at IS NULL) AS open_gaps")
def d06(spark, d):
    parts = [
        pages(spark, d).agg(F.count("*").alias("n")).withColumn("k", F.lit("pages")),
        table(spark, d, "links").agg(F.countDistinct("link_id").alias("n")).withColumn("k", F.lit("links")),
        table(spark, d, "knowledge_gaps").where("resolved_at is null").agg(F.countDistinct("gap_id").alias("n")).withColumn("k", F.lit("open_gaps")),
    ]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return u.agg(*(F.max(F.when(F.col("k") == k, F.col("n"))).alias(k) for k in ("pages", "links", "open_gaps")))


@reg("d07_conditional_sums", "SELECT event_type, count(*) FILTER (value > 50) AS large, count(*) FILTER (value <= 50) AS small, count(*) AS n FROM events GROUP BY 1")
def d07(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("large"), F.count_if(F.col("value") <= 50).alias("small"), F.count("*").alias("n"))


@reg("d08_latest_of_greatest", "SELECT sensitivity, strftime(max(greatest(detected_at, coalesce(resolved_at, detected_at))), '%Y-%m-%d %H:%M:%S') AS latest FROM knowledge_gaps GROUP BY 1")
def d08(spark, d):
    return table(spark, d, "knowledge_gaps").groupBy("sensitivity").agg(F.date_format(F.max(F.greatest("detected_at", F.coalesce("resolved_at", "detected_at"))), "yyyy-MM-dd HH:mm:ss").alias("latest"))


@reg("d09_latest_event", "SELECT user_id, event_type, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest FROM events GROUP BY 1, 2")
def d09(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("latest"))


@reg("d10_page_state_counts", "SELECT p.page_id, coalesce(o.n, 0) AS outbound, coalesce(i.n, 0) AS inbound, coalesce(a.n, 0) AS assertions FROM mem_pages p LEFT JOIN (SELECT from_page_id AS k, count(DISTINCT link_id) AS n FROM links GROUP BY 1) o ON o.k = p.page_id LEFT JOIN (SELECT to_page_id AS k, count(DISTINCT link_id) AS n FROM links GROUP BY 1) i ON i.k = p.page_id LEFT JOIN (SELECT page_id AS k, count(DISTINCT assertion_id) AS n FROM assertions GROUP BY 1) a ON a.k = p.page_id")
def d10(spark, d):
    out = pages(spark, d).select("page_id")
    for name, df, key, one in (("outbound", table(spark, d, "links"), "from_page_id", "link_id"), ("inbound", table(spark, d, "links"), "to_page_id", "link_id"), ("assertions", table(spark, d, "assertions"), "page_id", "assertion_id")):
        n = df.select(F.col(key).alias("page_id"), one).distinct().groupBy("page_id").agg(F.count("*").alias(name))
        out = out.join(n, "page_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


@reg("d11_max_similarity_to_page", "SELECT label, round(max(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 1) AS DOUBLE[]))), 6) AS best FROM embeddings WHERE vec_id <> 1 GROUP BY 1")
def d11(spark, d):
    e = table(spark, d, "embeddings")
    q = list(e.where("vec_id = 1").first()["embedding"])
    return ve.best_chunk(ve.score_against(e.where("vec_id <> 1"), q), "label").select("label", F.round("score", 6).alias("best"))


@reg("d12_distinct_subjects", "SELECT DISTINCT lower(trim(subject)) AS subject FROM assertions")
def d12(spark, d):
    return table(spark, d, "assertions").select(F.lower(F.trim("subject")).alias("subject")).distinct()


@reg("d13_max_score_normaliser", "SELECT greatest(0.0, max(value)) AS best FROM events")
def d13(spark, d):
    return table(spark, d, "events").agg(F.greatest(F.lit(0.0), F.max("value")).alias("best"))


@reg("d14_queue_position", "SELECT gap_id, row_number() OVER (PARTITION BY page_id ORDER BY detected_at, gap_id) AS position FROM (SELECT DISTINCT gap_id, page_id, detected_at FROM knowledge_gaps WHERE resolved_at IS NULL AND page_id IS NOT NULL)", longs=('position',))
def d14(spark, d):
    g = table(spark, d, "knowledge_gaps").where("resolved_at is null and page_id is not null").select("gap_id", "page_id", "detected_at").distinct()
    return g.select("gap_id", F.row_number().over(Window.partitionBy("page_id").orderBy("detected_at", "gap_id")).alias("position"))


@reg("d15_session_summary", "SELECT user_id, count(*) AS n, arg_max(event_type, (ts, event_id)) AS last_type, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_at FROM events GROUP BY 1")
def d15(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_at"))


_RANKED = "r AS (SELECT label AS qid, vec_id AS did, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rank, CASE WHEN vec_id % 3 = 0 THEN 1.0 WHEN vec_id % 3 = 1 THEN 0.5 ELSE 0.0 END AS rel FROM embeddings), i AS (SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, did) AS rank FROM r)"


def _runs(spark: SparkSession, d: str):
    rel = F.when(F.col("vec_id") % 3 == 0, 1.0).when(F.col("vec_id") % 3 == 1, 0.5).otherwise(0.0)
    e = table(spark, d, "embeddings").select(F.col("label").alias("qid"), F.col("vec_id").alias("did"), rel.alias("rel"))
    return e.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("did")))


@reg("d16_ndcg_at_10", f"WITH {_RANKED}, a AS (SELECT qid, sum(rel / log2(rank + 1)) AS g FROM r WHERE rank <= 10 GROUP BY 1), b AS (SELECT qid, sum(rel / log2(rank + 1)) AS g FROM i WHERE rank <= 10 GROUP BY 1) SELECT a.qid, round(CASE WHEN b.g = 0 THEN 1 ELSE a.g / b.g END, 6) AS ndcg FROM a JOIN b USING (qid)")
def d16(spark, d):
    r = _runs(spark, d)
    gain = lambda rank: F.sum(F.when(rank <= 10, F.col("rel") / F.log2(rank + 1)))
    ideal = r.withColumn("best", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("rel").desc(), "did")))
    g = ideal.groupBy("qid").agg(gain(F.col("rank")).alias("a"), gain(F.col("best")).alias("b"))
    return g.select("qid", F.round(F.when(F.col("b") == 0, 1.0).otherwise(F.col("a") / F.col("b")), 6).alias("ndcg"))


@reg("d17_recall_at_10", f"WITH {_RANKED} SELECT qid, count(*) FILTER (rank <= 10 AND rel = 1) / CAST(count(*) FILTER (rel = 1) AS DOUBLE) AS recall FROM r GROUP BY 1 HAVING count(*) FILTER (rel = 1) > 0")
def d17(spark, d):
    g = _runs(spark, d).groupBy("qid").agg(F.count_if((F.col("rank") <= 10) & (F.col("rel") == 1)).alias("a"), F.count_if(F.col("rel") == 1).alias("b"))
    return g.where("b > 0").select("qid", (F.col("a") / F.col("b")).alias("recall"))


_SET = "list_filter(list_distinct(string_split_regex(lower(coalesce({0}, '')), '\\s+')), lambda x: x <> '')"


@reg("d18_token_f1", f"WITH s AS (SELECT page_id, {_SET.format('title')} AS a, {_SET.format('summary')} AS b FROM mem_pages), t AS (SELECT page_id, len(a) AS na, len(b) AS nb, len(list_intersect(a, b)) AS n FROM s) SELECT page_id, round(CASE WHEN n = 0 THEN 0 ELSE 2.0 * n / (na + nb) END, 6) AS f1 FROM t")
def d18(spark, d):
    a, b = tx.words_set(F.coalesce("title", F.lit(""))), tx.words_set(F.coalesce("summary", F.lit("")))
    n = F.size(F.array_intersect(a, b))
    return pages(spark, d).select("page_id", F.round(F.when(n == 0, 0.0).otherwise(2.0 * n / (F.size(a) + F.size(b))), 6).alias("f1"))


@reg("d19_percentiles", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, max(value) FILTER (i = CAST(ceil(50 * (n - 1) / 100.0) AS BIGINT)) AS p50, max(value) FILTER (i = CAST(ceil(95 * (n - 1) / 100.0) AS BIGINT)) AS p95 FROM r GROUP BY 1")
def d19(spark, d):
    """Nearest rank: the value at index ceil(p * (n - 1) / 100). percentile_disc at the middle of that index's step, by counts per value."""
    v = table(spark, d, "events").groupBy("event_type", "value").agg(F.count("*").alias("c"))
    w = Window.partitionBy("event_type")
    upto = F.sum("c").over(w.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    v = v.withColumn("n", F.sum("c").over(w)).withColumn("hi", upto).withColumn("lo", F.col("hi") - F.col("c"))
    at = lambda p: F.ceil(F.lit(p) * (F.col("n") - 1) / 100)
    pick = lambda p: F.max(F.when((F.col("lo") <= at(p)) & (at(p) < F.col("hi")), F.col("value")))
    return v.groupBy("event_type").agg(pick(50).alias("p50"), pick(95).alias("p95"))


# --- ordering and sets -------------------------------------------------------------------------------------------------------


@reg("f07_timeline_newest", "WITH e AS (SELECT page_id, unnest(regexp_extract_all(timeline, '\\*\\*([0-9]{4}-[0-9]{2}-[0-9]{2})\\*\\*', 1)) AS day FROM mem_pages WHERE timeline IS NOT NULL), r AS (SELECT page_id, day, row_number() OVER (PARTITION BY page_id ORDER BY day DESC) AS rn FROM (SELECT DISTINCT page_id, day FROM e)) SELECT page_id, day, rn FROM r WHERE rn <= 5", longs=('rn',))
def f07(spark, d):
    e = pages(spark, d).select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("timeline", F.lit(r"\*\*([0-9]{4}-[0-9]{2}-[0-9]{2})\*\*"), F.lit(1)))).alias("day"))
    return e.withColumn("rn", F.row_number().over(Window.partitionBy("page_id").orderBy(F.col("day").desc()))).where("rn <= 5")


@reg("f08_open_gaps", "SELECT gap_id FROM (SELECT DISTINCT gap_id, detected_at FROM knowledge_gaps WHERE resolved_at IS NULL) ORDER BY detected_at DESC, gap_id LIMIT 50")
def f08(spark, d):
    g = table(spark, d, "knowledge_gaps").where("resolved_at is null").select("gap_id", "detected_at").distinct()
    return g.orderBy(F.col("detected_at").desc(), "gap_id").limit(50).select("gap_id")


@reg("f09_namespaces", "SELECT namespace_id, ttl_hours FROM page_namespaces ORDER BY created_at, namespace_id")
def f09(spark, d):
    return table(spark, d, "page_namespaces").orderBy("created_at", "namespace_id").select("namespace_id", "ttl_hours")


@reg("f10_keyset_page", "SELECT page_id FROM mem_pages WHERE page_id > 100 ORDER BY page_id LIMIT 32")
def f10(spark, d):
    return pages(spark, d).where("page_id > 100").orderBy("page_id").limit(32).select("page_id")


@reg("f11_token_costs", "SELECT page_id, (length(coalesce(compiled_truth, '')) + length(coalesce(timeline, ''))) // 4 AS cost FROM mem_pages")
def f11(spark, d):
    n = F.length(F.coalesce("compiled_truth", F.lit(""))) + F.length(F.coalesce("timeline", F.lit("")))
    return pages(spark, d).select("page_id", F.floor(n / 4).alias("cost"))


@reg("f12_due_audit", "SELECT page_id FROM mem_pages ORDER BY updated_at, page_id LIMIT (SELECT CAST(ceil(count(*) / 30.0) AS BIGINT) FROM mem_pages)")
def f12(spark, d):
    p = pages(spark, d)
    return p.orderBy("updated_at", "page_id").limit(-(-p.count() // 30)).select("page_id")


@reg("f13_job_order", "SELECT assertion_id, row_number() OVER (PARTITION BY asserted_by ORDER BY confidence DESC NULLS LAST, created_at, assertion_id) AS place FROM (SELECT DISTINCT assertion_id, asserted_by, confidence, created_at FROM assertions)", longs=('place',))
def f13(spark, d):
    a = table(spark, d, "assertions").select("assertion_id", "asserted_by", "confidence", "created_at").distinct()
    w = Window.partitionBy("asserted_by").orderBy(F.col("confidence").desc_nulls_last(), "created_at", "assertion_id")
    return a.select("assertion_id", F.row_number().over(w).alias("place"))


@reg("f14_recent_notes", f"SELECT DISTINCT gap_id, substr(context, 1, 20) AS context FROM knowledge_gaps WHERE detected_at >= TIMESTAMP '{NOW}' - INTERVAL 365 DAY")
def f14(spark, d):
    g = table(spark, d, "knowledge_gaps").where(F.col("detected_at") >= F.expr(f"TIMESTAMP_NTZ '{NOW}' - INTERVAL 365 DAY"))
    return g.select("gap_id", F.substring("context", 1, 20).alias("context")).distinct()


@reg("g06_undirected_neighbours", "SELECT from_page_id AS page_id, to_page_id AS other FROM links WHERE valid_until IS NULL UNION SELECT to_page_id, from_page_id FROM links WHERE valid_until IS NULL")
def g06(spark, d):
    o = table(spark, d, "links").where("valid_until is null")
    a = o.select(F.col("from_page_id").alias("page_id"), F.col("to_page_id").alias("other"))
    return a.union(a.select("other", "page_id")).distinct()


@reg("g07_stale_links", "SELECT DISTINCT link_id FROM links l WHERE source_kind = 'wiki_link' AND NOT EXISTS (SELECT 1 FROM links k WHERE k.source_kind = 'frontmatter' AND k.from_page_id = l.from_page_id AND k.to_page_id = l.to_page_id)")
def g07(spark, d):
    l_ = links(spark, d)
    keep = l_.where("source_kind = 'frontmatter'").select("from_page_id", "to_page_id").distinct()
    return gr.unlink(l_.where("source_kind = 'wiki_link'"), keep, ["from_page_id", "to_page_id"]).select("link_id")


@reg("g09_triples_by_source", """
SELECT assertion_id FROM (SELECT assertion_id, row_number() OVER (PARTITION BY lower(trim(subject)), lower(trim(predicate)), object_text ORDER BY CASE asserted_by WHEN 'manual' THEN 0 WHEN 'agent' THEN 1 ELSE 2 END, assertion_id) AS rn FROM (SELECT DISTINCT assertion_id, subject, predicate, object_text, asserted_by FROM assertions)) WHERE rn = 1""")  # fmt: skip
def g09(spark, d):
    a = table(spark, d, "assertions").select("assertion_id", "subject", "predicate", "object_text", "asserted_by").distinct()
    a = a.withColumns({"s": F.lower(F.trim("subject")), "p": F.lower(F.trim("predicate"))})
    rank = F.when(F.col("asserted_by") == "manual", 0).when(F.col("asserted_by") == "agent", 1).otherwise(2)
    return sy.latest(a, ["s", "p", "object_text"], rank, F.col("assertion_id")).select("assertion_id")


@reg("g08_stale_assertions", "SELECT DISTINCT assertion_id FROM assertions a WHERE asserted_by = 'agent' AND NOT EXISTS (SELECT 1 FROM assertions k WHERE k.asserted_by = 'extraction' AND k.subject = a.subject AND k.predicate = a.predicate AND k.object_text = a.object_text)")
def g08(spark, d):
    a = table(spark, d, "assertions").dropDuplicates(["assertion_id"])
    keep = a.where("asserted_by = 'extraction'").select("subject", "predicate", "object_text").distinct()
    return a.where("asserted_by = 'agent'").join(keep, ["subject", "predicate", "object_text"], "left_anti").select("assertion_id")


_TAGS = "CASE WHEN json_valid(frontmatter) AND json_extract(frontmatter, '$.tags') IS NOT NULL THEN list_filter(list_transform(CASE WHEN json_type(frontmatter, '$.tags') = 'ARRAY' THEN CAST(json_extract(frontmatter, '$.tags') AS VARCHAR[]) ELSE string_split(json_extract_string(frontmatter, '$.tags'), ',') END, lambda x: trim(x)), lambda x: x <> '') END"


@reg("g10_tag_rows", f"SELECT DISTINCT page_id, unnest({_TAGS}) AS tag FROM mem_pages")
def g10(spark, d):
    return pages(spark, d).select("page_id", F.explode(tx.tags(F.col("frontmatter"))).alias("tag")).distinct()


@reg("g11_tag_counts", f"SELECT tag, count(*) AS n FROM (SELECT DISTINCT page_id, unnest({_TAGS}) AS tag FROM mem_pages) GROUP BY 1")
def g11(spark, d):
    return g10(spark, d).groupBy("tag").agg(F.count("*").alias("n"))


@reg("g05_graph_additions", "SELECT DISTINCT from_page_id AS page_id FROM links WHERE to_page_id % 50 = 0 UNION SELECT page_id FROM mem_pages WHERE page_id % 50 = 0")
def g05(spark, d):
    a = table(spark, d, "links").where("to_page_id % 50 = 0").select(F.col("from_page_id").alias("page_id"))
    return a.unionByName(pages(spark, d).where("page_id % 50 = 0").select("page_id")).distinct()


@reg("g05_all_graph_additions", "SELECT DISTINCT from_page_id AS page_id FROM links WHERE to_page_id IS NOT NULL UNION SELECT page_id FROM mem_pages")
def g05_all(spark, d):
    a = table(spark, d, "links").where("to_page_id is not null").select(F.col("from_page_id").alias("page_id"))
    return a.unionByName(pages(spark, d).select("page_id")).distinct()


# --- edges, hygiene, sync ----------------------------------------------------------------------------------------------------


@reg("a22_first_derived_edge", "SELECT min(link_id) AS link_id FROM links GROUP BY from_page_id, to_page_id, lower(trim(relationship)), source_kind")
def a22(spark, d):
    l_ = table(spark, d, "links").withColumn("r", F.lower(F.trim("relationship")))
    return gr.keep_first(l_, ["from_page_id", "to_page_id", "r", "source_kind"], "link_id").select("link_id")


_CHANGES = "SELECT link_id + 1000000 AS link_id, from_page_id, to_page_id, relationship, context, source_kind, edge_weight / 2 AS edge_weight, valid_from, valid_until, created_at FROM (SELECT DISTINCT * FROM links) WHERE link_id % 3 = 0"


@reg("j07_edge_upsert", f"WITH b AS (SELECT *, 0 AS batch FROM (SELECT DISTINCT * FROM links) UNION ALL SELECT *, 1 FROM ({_CHANGES})) SELECT link_id, edge_weight FROM (SELECT *, row_number() OVER (PARTITION BY from_page_id, to_page_id, relationship, source_kind ORDER BY batch DESC, link_id DESC) AS rn FROM b) WHERE rn = 1 OR source_kind = 'programmatic' OR source_kind IS NULL")
def j07(spark, d):
    l_ = links(spark, d)
    ch = l_.where("link_id % 3 = 0").withColumn("link_id", F.col("link_id") + 1000000).withColumn("edge_weight", F.col("edge_weight") / 2)
    return gr.upsert_edges(l_, ch).select("link_id", "edge_weight")


@reg("j05_close_links", "SELECT DISTINCT link_id, CASE WHEN lower(trim(relationship)) = 'works_at' AND valid_until IS NULL THEN '2025-01-01' ELSE valid_until END AS valid_until FROM links")
def j05(spark, d):
    out = gr.close_link(links(spark, d), F.lower(F.trim("relationship")) == "works_at", "2025-01-01")
    return out.select("link_id", "valid_until")


@reg("j06_close_link_by_id", "SELECT DISTINCT link_id, CASE WHEN link_id % 50 = 0 AND valid_until IS NULL THEN '2025-01-01' ELSE valid_until END AS valid_until FROM links")
def j06(spark, d):
    return gr.close_link(links(spark, d), F.col("link_id") % 50 == 0, "2025-01-01").select("link_id", "valid_until")


@reg("j04_unlink", "SELECT DISTINCT link_id FROM links WHERE NOT EXISTS (SELECT 1 FROM mem_pages p WHERE p.page_id = from_page_id AND p.superseded_by = to_page_id) AND to_page_id <> 1")
def j04(spark, d):
    gone = pages(spark, d).where("superseded_by is not null").select(F.col("page_id").alias("from_page_id"), F.col("superseded_by").alias("to_page_id"))
    return gr.unlink(links(spark, d).where("to_page_id <> 1"), gone, ["from_page_id", "to_page_id"]).select("link_id")


@reg("j11_wikilink_edges", """
WITH x AS (SELECT p.page_id, coalesce(p.compiled_truth, '') || coalesce(' see [[' || s.slug || ']]', '') AS compiled_truth FROM mem_pages p LEFT JOIN mem_pages s ON s.page_id = p.superseded_by), w AS (SELECT DISTINCT page_id, unnest(list_transform(regexp_extract_all(compiled_truth, '\\[\\[([^\\[\\]]+)\\]\\]', 1), lambda x: regexp_replace(regexp_replace(replace(lower(regexp_replace(x, '^\\s+|\\s+$', '', 'g')), ' ', '-'), '^/+|/+$', '', 'g'), '/+', '/', 'g'))) AS slug FROM x)
SELECT w.page_id AS from_page_id, t.page_id AS to_page_id, 'related' AS relationship, CAST(0.5 AS DOUBLE) AS edge_weight FROM w JOIN mem_pages t ON t.slug = w.slug WHERE t.page_id <> w.page_id""")  # fmt: skip
def j11(spark, d):
    """The vault's own links name pages it doesn't have; so every superseded page has a link to its successor added."""
    p = pages(spark, d)
    s = p.select(F.col("page_id").alias("superseded_by"), F.concat(F.lit(" see [["), "slug", F.lit("]]")).alias("more"))
    x = p.join(s, "superseded_by", "left").select("page_id", F.concat(F.coalesce("compiled_truth", F.lit("")), F.coalesce("more", F.lit(""))).alias("compiled_truth"))
    w = x.select(F.col("page_id").alias("from_page_id"), F.explode(tx.wikilinks(F.col("compiled_truth"))).alias("slug")).distinct()
    t = p.select("slug", F.col("page_id").alias("to_page_id"))
    return w.join(t, "slug").where("from_page_id <> to_page_id").select("from_page_id", "to_page_id", F.lit("related").alias("relationship"), F.lit(0.5).alias("edge_weight"))


@reg("j08_frontmatter_fields", "SELECT page_id, key, value FROM (SELECT page_id, unnest(['title', 'type', 'wing', 'slug']) AS key, unnest([json_extract_string(frontmatter, '$.title'), json_extract_string(frontmatter, '$.type'), json_extract_string(frontmatter, '$.wing'), json_extract_string(frontmatter, '$.slug')]) AS value FROM mem_pages WHERE json_valid(frontmatter)) WHERE value IS NOT NULL")
def j08(spark, d):
    m = F.array(*(F.struct(F.lit(k).alias("key"), F.get_json_object("frontmatter", f"$.{k}").alias("value")) for k in ("title", "type", "wing", "slug")))
    return pages(spark, d).select("page_id", F.explode(m).alias("m")).select("page_id", "m.key", "m.value").where("value is not null")


@reg("j15_supersede_checks", "SELECT a.page_id, CASE WHEN a.superseded_by = a.page_id THEN 'self' WHEN b.page_id IS NULL THEN 'unknown' WHEN b.superseded_by IS NOT NULL THEN 'not head' WHEN b.collection_id <> a.collection_id THEN 'other collection' ELSE 'ok' END AS verdict FROM mem_pages a LEFT JOIN mem_pages b ON b.page_id = a.superseded_by WHERE a.superseded_by IS NOT NULL")
def j15(spark, d):
    p = pages(spark, d)
    a = p.where("superseded_by is not null").select("page_id", F.col("superseded_by").alias("t"), "collection_id")
    b = p.select(F.col("page_id").alias("t"), F.lit(True).alias("there"), F.col("superseded_by").alias("t2"), F.col("collection_id").alias("c2"))
    v = F.when(F.col("t") == F.col("page_id"), "self").when(F.col("there").isNull(), "unknown").when(F.col("t2").isNotNull(), "not head").when(F.col("c2") != F.col("collection_id"), "other collection").otherwise("ok")
    return a.join(b, "t", "left").select("page_id", v.alias("verdict"))


@reg("k41_gap_rule", "SELECT DISTINCT gap_id, coalesce(CAST(nullif(regexp_extract(context, 'top=([0-9.]+)', 1), '') AS DOUBLE), 0) < 0.3 AS gap FROM knowledge_gaps")
def k41(spark, d):
    top = F.nullif(F.regexp_extract("context", r"top=([0-9.]+)", 1), F.lit("")).cast("double")
    return table(spark, d, "knowledge_gaps").select("gap_id", hg.is_gap(top).alias("gap")).distinct()


@reg("k42_gap_context", "SELECT DISTINCT gap_id, 'auto: hybrid results=' || length(coalesce(query_text, '')) || ' top=' || printf('%.2f', coalesce(confidence_score, 0)) AS context FROM knowledge_gaps")
def k42(spark, d):
    g = table(spark, d, "knowledge_gaps")
    return g.select("gap_id", hg.gap_context("hybrid", F.length(F.coalesce("query_text", F.lit(""))), F.col("confidence_score")).alias("context")).distinct()


@reg("l11_log_gaps", "SELECT DISTINCT sha256(title) AS query_hash FROM mem_pages WHERE title IS NOT NULL AND sha256(title) NOT IN (SELECT query_hash FROM knowledge_gaps WHERE query_hash IS NOT NULL)")
def l11(spark, d):
    asked = pages(spark, d).where("title is not null").select(F.col("title").alias("query_text"))
    return hg.log_gaps(table(spark, d, "knowledge_gaps"), asked).select("query_hash")


@reg("l04_assertion_mirror", "SELECT page_id, lower(trim(page_type)) AS kind, coalesce(nullif(summary, ''), title) AS summary FROM mem_pages WHERE superseded_by IS NULL AND json_valid(frontmatter) AND json_extract_string(frontmatter, '$.type') IS NOT NULL")
def l04(spark, d):
    p = pages(spark, d).where(F.col("superseded_by").isNull() & F.get_json_object("frontmatter", "$.type").isNotNull())
    return p.select("page_id", F.lower(F.trim("page_type")).alias("kind"), tx.first_nonblank(F.col("summary"), F.col("title")).alias("summary"))


@reg("l08_resolved_by_supersede", f"WITH {_CONTRA} SELECT low, high FROM con WHERE pa IN (SELECT page_id FROM mem_pages WHERE superseded_by IS NOT NULL) OR pb IN (SELECT page_id FROM mem_pages WHERE superseded_by IS NOT NULL)")
def l08(spark, d):
    old = pages(spark, d).where("superseded_by is not null").select("page_id")
    gone = table(spark, d, "assertions").select("assertion_id", "page_id").distinct().join(old, "page_id", "left_semi").select("assertion_id")
    c = hg.contradictions(table(spark, d, "assertions")).select("low", "high")
    a = c.join(gone.withColumnRenamed("assertion_id", "low"), "low", "left_semi").select("low", "high")
    return a.unionByName(c.join(gone.withColumnRenamed("assertion_id", "high"), "high", "left_semi").select("low", "high")).distinct()


@reg("l15_namespace_cascade", "SELECT (SELECT count(*) FROM mem_pages WHERE namespace_id <> 'team-orchard') AS pages, (SELECT count(DISTINCT link_id) FROM links WHERE from_page_id NOT IN (SELECT page_id FROM mem_pages WHERE namespace_id = 'team-orchard') AND to_page_id NOT IN (SELECT page_id FROM mem_pages WHERE namespace_id = 'team-orchard')) AS links")
def l15(spark, d):
    p = pages(spark, d)
    gone = p.where("namespace_id = 'team-orchard'").select("page_id")
    l_ = links(spark, d)
    for side in ("from_page_id", "to_page_id"):
        l_ = l_.join(gone.select(F.col("page_id").alias(side)), side, "left_anti")
    a = p.where("namespace_id <> 'team-orchard'").agg(F.count("*").alias("n")).select(F.lit("p").alias("k"), "n")
    u = a.unionByName(l_.agg(F.count("*").alias("n")).select(F.lit("l").alias("k"), "n"))
    return u.agg(F.max(F.when(F.col("k") == "p", F.col("n"))).alias("pages"), F.max(F.when(F.col("k") == "l", F.col("n"))).alias("links"))


@reg("l16_timeline_entries", "WITH e AS (SELECT page_id, unnest(regexp_extract_all(timeline, '(?:^|\\n)- \\*\\*([0-9]{4}-[0-9]{2}-[0-9]{2})\\*\\* \\| ([^\\n]+)', 1)) AS day, unnest(regexp_extract_all(timeline, '(?:^|\\n)- \\*\\*([0-9]{4}-[0-9]{2}-[0-9]{2})\\*\\* \\| ([^\\n]+)', 2)) AS entry FROM mem_pages WHERE timeline IS NOT NULL) SELECT DISTINCT page_id, day, sha256(entry) AS entry_hash FROM e")
def l16(spark, d):
    p = F.lit(r"(?:^|\n)- \*\*([0-9]{4}-[0-9]{2}-[0-9]{2})\*\* \| ([^\n]+)")
    e = pages(spark, d).select("page_id", F.explode(F.arrays_zip(F.regexp_extract_all("timeline", p, F.lit(1)).alias("day"), F.regexp_extract_all("timeline", p, F.lit(2)).alias("entry"))).alias("e"))
    return e.select("page_id", "e.day", F.sha2("e.entry", 256).alias("entry_hash")).distinct()


@reg("l20_quarantine_or_delete", """
SELECT page_id, CASE WHEN page_id IN (SELECT page_id FROM assertions WHERE asserted_by <> 'import') OR page_id IN (SELECT from_page_id FROM links WHERE source_kind = 'programmatic') THEN 'quarantine' ELSE 'delete' END AS action FROM mem_pages WHERE superseded_by IS NOT NULL""")  # fmt: skip
def l20(spark, d):
    held = table(spark, d, "assertions").where("asserted_by <> 'import'").select("page_id").unionByName(table(spark, d, "links").where("source_kind = 'programmatic'").select(F.col("from_page_id").alias("page_id"))).distinct().withColumn("held", F.lit(True))
    gone = pages(spark, d).where("superseded_by is not null").select("page_id")
    return gone.join(held, "page_id", "left").select("page_id", F.when(F.col("held"), "quarantine").otherwise("delete").alias("action"))


@reg("l26_integrity", "SELECT problem, n FROM (SELECT 'overlap' AS problem, count(*) AS n FROM (WITH o AS (SELECT DISTINCT link_id, from_page_id, to_page_id, relationship, valid_from, valid_until FROM links) SELECT 1 FROM o a JOIN o b ON a.from_page_id = b.from_page_id AND a.to_page_id = b.to_page_id AND a.relationship = b.relationship AND a.link_id < b.link_id AND coalesce(a.valid_from, '') < coalesce(b.valid_until, '9999-12-31') AND coalesce(b.valid_from, '') < coalesce(a.valid_until, '9999-12-31')) UNION ALL SELECT 'dangling link', count(DISTINCT link_id) FROM links WHERE to_page_id NOT IN (SELECT page_id FROM mem_pages) OR from_page_id NOT IN (SELECT page_id FROM mem_pages) UNION ALL SELECT 'dangling assertion', count(DISTINCT assertion_id) FROM assertions WHERE page_id NOT IN (SELECT page_id FROM mem_pages) UNION ALL SELECT 'dangling predecessor', count(DISTINCT assertion_id) FROM assertions WHERE supersedes_id IS NOT NULL AND supersedes_id NOT IN (SELECT assertion_id FROM assertions)) WHERE n > 0")
def l26(spark, d):
    a = hg.overlapping_links(table(spark, d, "links")).agg(F.count("*").alias("n")).select(F.lit("overlap").alias("problem"), "n")
    b = hg.dangling_references(links(spark, d), table(spark, d, "assertions"), pages(spark, d)).groupBy("problem").agg(F.count("*").alias("n"))
    return a.where("n > 0").unionByName(b)


@reg("i18_novelty", f"""
WITH w AS (SELECT page_id, {_SET.format('compiled_truth')} AS s FROM mem_pages), c AS (SELECT * FROM w WHERE page_id % 50 = 0 AND len(s) > 0)
SELECT c.page_id AS cand, w.page_id AS page, round(len(list_intersect(c.s, w.s)) / (len(c.s) + len(w.s) - len(list_intersect(c.s, w.s))), 6) AS jaccard FROM c JOIN w ON w.page_id <> c.page_id AND len(w.s) > 0
WHERE len(list_intersect(c.s, w.s)) / (len(c.s) + len(w.s) - len(list_intersect(c.s, w.s))) >= 0.85""")  # fmt: skip
def i18(spark, d):
    """Pages that the pages with an id divisible by 50 repeat, among all pages."""
    p = pages(spark, d).select("page_id", F.coalesce("compiled_truth", F.lit("")).alias("compiled_truth"))
    return hg.novelty(p.where("page_id % 50 = 0"), p, "page_id", "compiled_truth").select("cand", "page", F.round("jaccard", 6).alias("jaccard"))


_BASE = "SELECT collection_id, namespace_id, slug, title, page_version FROM mem_pages"


@reg("a10_upsert", f"""
WITH ch AS (SELECT collection_id, namespace_id, CASE WHEN page_id % 9 = 0 THEN slug || '-new' ELSE slug END AS slug, title || '!' AS title, CASE WHEN page_id % 4 = 0 THEN NULL WHEN page_id % 3 = 0 THEN page_version ELSE page_version + 7 END AS expected FROM mem_pages WHERE page_id % 2 = 0),
m AS (SELECT ch.*, b.page_version AS stored FROM ch LEFT JOIN ({_BASE}) b USING (collection_id, namespace_id, slug)), ok AS (SELECT * FROM m WHERE expected IS NULL OR expected IS NOT DISTINCT FROM stored)
SELECT collection_id, namespace_id, slug, title, coalesce(stored, 0) + 1 AS page_version FROM ok UNION ALL
SELECT b.* FROM ({_BASE}) b WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.collection_id = b.collection_id AND ok.namespace_id = b.namespace_id AND ok.slug = b.slug)""")  # fmt: skip
def a10(spark, d):
    return _upserted(spark, d)[0].select("collection_id", "namespace_id", "slug", "title", "page_version")


def _upserted(spark: SparkSession, d: str):
    p = pages(spark, d)
    base = p.select("collection_id", "namespace_id", "slug", "title", "page_version")
    expected = F.when(F.col("page_id") % 4 == 0, None).when(F.col("page_id") % 3 == 0, F.col("page_version")).otherwise(F.col("page_version") + 7)
    slug = F.when(F.col("page_id") % 9 == 0, F.concat("slug", F.lit("-new"))).otherwise(F.col("slug"))
    ch = p.where("page_id % 2 = 0").select("collection_id", "namespace_id", slug.alias("slug"), F.concat("title", F.lit("!")).alias("title"), expected.alias("expected_version"))
    return sy.upsert(base, ch, ["collection_id", "namespace_id", "slug"])


@reg("a10_upsert_conflicts", f"""
WITH ch AS (SELECT collection_id, namespace_id, CASE WHEN page_id % 9 = 0 THEN slug || '-new' ELSE slug END AS slug, CASE WHEN page_id % 4 = 0 THEN NULL WHEN page_id % 3 = 0 THEN page_version ELSE page_version + 7 END AS expected FROM mem_pages WHERE page_id % 2 = 0)
SELECT ch.slug, ch.expected AS expected_version FROM ch LEFT JOIN ({_BASE}) b USING (collection_id, namespace_id, slug) WHERE NOT (expected IS NULL OR expected IS NOT DISTINCT FROM b.page_version)""")  # fmt: skip
def a10_conflicts(spark, d):
    return _upserted(spark, d)[1].select("slug", "expected_version")


@reg("a09_exact_duplicates", "SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM documents o WHERE o.text = d.text AND o.doc_id < d.doc_id)")
def a09(spark, d):
    t = table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    first = t.groupBy("h").agg(F.min("doc_id").alias("first"))
    return t.join(first, "h").where("doc_id > first").select("doc_id")


@reg("a11_page_read", "SELECT page_id, slug, uuid, title, page_version FROM mem_pages WHERE page_id % 50 = 0 AND uuid IS NOT NULL")
def a11(spark, d):
    return pages(spark, d).where("page_id % 50 = 0 and uuid is not null").select("page_id", "slug", "uuid", "title", "page_version")


@reg("a11_all_page_reads", "SELECT page_id, slug, uuid, title, page_version FROM mem_pages WHERE uuid IS NOT NULL")
def a11_all(spark, d):
    return pages(spark, d).where("uuid is not null").select("page_id", "slug", "uuid", "title", "page_version")


@reg("a15_active_import", "SELECT collection_id, rel_path, doc_id, rn = 1 AS is_active FROM (SELECT *, row_number() OVER (PARTITION BY collection_id, rel_path ORDER BY ingested_at DESC, doc_id DESC) AS rn FROM documents)")
def a15(spark, d):
    return sy.rotate(table(spark, d, "documents"), ["collection_id", "rel_path"], "doc_id", "ingested_at", "doc_id").select("collection_id", "rel_path", "doc_id", "is_active")


@reg("a16_prune_imports", f"""
WITH r AS (SELECT doc_id, source, ingested_at, doc_id % 10 = 0 AS active, date_sub('day', ingested_at, TIMESTAMP '{NOW}') AS age FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY source, active ORDER BY ingested_at DESC, doc_id DESC) AS rn FROM r) SELECT doc_id FROM n WHERE active OR (rn <= 10 AND age <= 900)""")  # fmt: skip
def a16(spark, d):
    age = F.timestamp_diff("DAY", F.col("ingested_at"), now())
    t = table(spark, d, "documents").select("doc_id", "source", "ingested_at", (F.col("doc_id") % 10 == 0).alias("active"), age.alias("age"))
    return sy.prune(t, ["source"], [F.col("ingested_at").desc(), F.col("doc_id").desc()], F.col("active"), 10, F.col("age"), 900).select("doc_id")


@reg("a17_expired_imports", f"SELECT doc_id FROM documents WHERE doc_id % 10 <> 0 AND date_sub('day', ingested_at, TIMESTAMP '{NOW}') > 900")
def a17(spark, d):
    return sy.expired(table(spark, d, "documents"), F.col("doc_id") % 10 == 0, F.timestamp_diff("DAY", F.col("ingested_at"), now()), 900).select("doc_id")


@reg("a18_latest_sidecar", "SELECT page_id, source_ref, max(assertion_id) AS assertion_id FROM assertions WHERE source_ref <> '' GROUP BY 1, 2")
def a18(spark, d):
    return sy.newest(table(spark, d, "assertions").where("source_ref <> ''"), ["page_id", "source_ref"], "assertion_id", "assertion_id")


@reg("a04_ignore_globs", "SELECT doc_id FROM documents WHERE NOT regexp_matches(rel_path, '(^|/)[.]git/|(^|/)node_modules/|[.]tmp$|^(notes|archive)/')")
def a04(spark, d):
    from ..sources.vault import ignored

    return table(spark, d, "documents").where(~ignored(F.col("rel_path"), ["**/.git/**", "**/node_modules/**", "**/*.tmp", "{notes,archive}/**"])).select("doc_id")


# --- conversations and queues ------------------------------------------------------------------------------------------------


@reg("e06_turn_windows", """
WITH t AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ordinal FROM events), c AS (SELECT *, ordinal > user_id % 60 AS new FROM t), n AS (SELECT *, count(*) FILTER (new) OVER (PARTITION BY user_id) AS n_new FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, new ORDER BY CASE WHEN new THEN ordinal ELSE -ordinal END) AS rn FROM n WHERE n_new > 0)
SELECT user_id, CASE WHEN new THEN (rn - 1) // 5 ELSE 0 END AS window_no, ordinal, NOT new AS lookback FROM r WHERE new OR (n_new < 5 AND rn <= 5 - n_new)""", longs=('ordinal', 'window_no'))  # fmt: skip
def e06(spark, d):
    t = table(spark, d, "events").select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("ordinal"))
    return cv.turn_windows(t, F.col("user_id") % 60, ["user_id"])


@reg("e05_chunk_index", "SELECT doc_id, unnest(range(0, len(string_split(text, chr(10) || '## ')))) AS chunk_index FROM documents WHERE text IS NOT NULL", longs=('chunk_index',))
def e05(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n## ", -1)).alias("chunk_index", "c")).select("doc_id", "chunk_index")


@reg("e04_numbered_parts", "WITH p AS (SELECT doc_id, string_split(text, chr(10) || '## ') AS x FROM documents WHERE text IS NOT NULL) SELECT doc_id, '[' || unnest(range(1, len(x) + 1)) || '/' || len(x) || ']' AS part FROM p")
def e04(spark, d):
    s = F.split("text", "\n## ", -1)
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(s)), lambda i: F.concat(F.lit("["), i, F.lit("/"), F.size(s), F.lit("]")))).alias("part"))


@reg("e08_best_margin", """
WITH s AS (SELECT a.vec_id, b.label, max(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS c FROM embeddings a JOIN embeddings b ON b.vec_id <> a.vec_id WHERE a.vec_id % 50 = 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, label) AS rn, lead(c) OVER (PARTITION BY vec_id ORDER BY c DESC, label) AS second FROM s) SELECT vec_id, label, round(c - second, 6) AS margin FROM r WHERE rn = 1""")  # fmt: skip
def e08(spark, d):
    e = table(spark, d, "embeddings")
    g = ve.best_by_label(e, e.where("vec_id % 50 = 0")).withColumnRenamed("score", "c")
    w = Window.partitionBy("query_id").orderBy(F.col("c").desc(), "label")
    r = g.withColumn("rn", F.row_number().over(w)).withColumn("second", F.lead("c").over(w)).where("rn = 1")
    return r.select(F.col("query_id").alias("vec_id"), "label", F.round(F.col("c") - F.col("second"), 6).alias("margin"))


@reg("m05_idle_sessions", """
WITH g AS (SELECT user_id, event_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR date_diff('microsecond', lag(ts) OVER w, ts) >= 43200000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session_no FROM g) SELECT user_id, CAST(session_no AS BIGINT) AS session_no, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started FROM s GROUP BY 1, 2""")  # fmt: skip
def m05(spark, d):
    s = cv.idle_sessions(table(spark, d, "events"), "user_id", "ts", 12 * 3600)
    return s.select("user_id", "session_no", "n", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"))


_REQ = "SELECT user_id, event_id, strftime(ts + INTERVAL 5 SECOND, '%Y-%m-%dT%H:%M:%SZ') AS due, CASE WHEN event_id % 41 = 0 THEN 'session_close' WHEN event_id % 5 = 0 THEN 'manual' ELSE 'debounce' END AS kind FROM events"


def _requests(spark: SparkSession, d: str):
    kind = F.when(F.col("event_id") % 41 == 0, "session_close").when(F.col("event_id") % 5 == 0, "manual").otherwise("debounce")
    at = F.date_format(F.col("ts") + F.expr("INTERVAL 5 SECOND"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, d, "events").select("user_id", "event_id", kind.alias("kind"), at.alias("due"))


@reg("m08_trigger_merge", f"""
WITH q AS ({_REQ}), l AS (SELECT *, coalesce(max(CASE WHEN kind = 'session_close' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed FROM q),
g AS (SELECT user_id, max(due) FILTER (kind = 'session_close') AS c, min(due) FILTER (kind = 'manual') AS m, max(due) FILTER (kind = 'debounce') AS d FROM l WHERE closed = 0 GROUP BY 1)
SELECT user_id, CASE WHEN c IS NOT NULL THEN 'session_close' WHEN m IS NOT NULL THEN 'manual' ELSE 'debounce' END AS kind, CASE WHEN c IS NOT NULL THEN CASE WHEN coalesce(m, d) < c THEN coalesce(m, d) ELSE c END ELSE coalesce(m, d) END AS due FROM g""")  # fmt: skip
def m08(spark, d):
    return cv.merged_jobs(_requests(spark, d), "user_id", "kind", "due", "event_id").withColumnsRenamed({"trigger": "kind", "at": "due"})


@reg("m07_debounce", "SELECT user_id, event_type, strftime(max(ts) + INTERVAL 5 SECOND, '%Y-%m-%dT%H:%M:%SZ') AS due FROM events GROUP BY 1, 2")
def m07(spark, d):
    g = sy.debounce(table(spark, d, "events"), ["user_id", "event_type"], "ts", 5)
    return g.select("user_id", "event_type", F.date_format("due", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("due"))


@reg("m17_latest_job", "SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def m17(spark, d):
    return sy.newest(table(spark, d, "events"), ["user_id"], "event_id", "ts", "event_id")


@reg("m01_turn_ordinals", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ordinal FROM events", longs=('ordinal',))
def m01(spark, d):
    return cv.ordinals(table(spark, d, "events"), "user_id", "ts", "event_id").select("event_id", "ordinal")


@reg("m10_claim_next", "SELECT event_type, min_by(event_id, (ts, event_id)) AS event_id FROM events WHERE value > 20 GROUP BY 1")
def m10(spark, d):
    return sy.claim(table(spark, d, "events").where("value > 20"), ["event_type"], 1, F.col("ts"), F.col("event_id")).select("event_type", "event_id")


@reg("l01_fact_bands", """
WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings), h AS (SELECT label, count(*) AS n, min(vec_id) AS head FROM r WHERE rn <= label % 3 GROUP BY 1),
f AS (SELECT e.vec_id, e.label, h.n, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(x.embedding AS DOUBLE[])) AS c FROM embeddings e JOIN r ON r.vec_id = e.vec_id AND r.rn > e.label % 3 LEFT JOIN h ON h.label = e.label LEFT JOIN embeddings x ON x.vec_id = h.head)
SELECT vec_id, CASE WHEN n IS NULL THEN 'coexist' WHEN n > 1 THEN 'ambiguous' WHEN c > 0.92 THEN 'drop' WHEN c >= 0.4 THEN 'supersede' ELSE 'coexist' END AS resolution FROM f""")  # fmt: skip
def l01(spark, d):
    """A label has no, one or two heads by its number; all other vectors are facts that meet them."""
    e = table(spark, d, "embeddings").withColumn("rn", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")))
    heads = e.where("rn <= label % 3").select("label", F.col("vec_id").alias("head_id"), F.col("embedding").alias("head_embedding"))
    out = cv.resolve_facts(e.where("rn > label % 3"), heads, ["label"], ve.cosine(F.col("embedding"), F.col("head_embedding")))
    return out.select("vec_id", "resolution")


# --- the relational vocabulary on the star schema -----------------------------------------------------------------------------


@reg("t1_pricing_summary", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def t1(spark, d):
    l_ = table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02 00:00:00'")
    return l_.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@reg("t5_nation_revenue", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA' GROUP BY 1")
def t5(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey"))
    l_ = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    return l_.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("n_name").agg(F.round(F.sum("v"), 2).alias("revenue"))


@reg("t4_orders_with_late_lines", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate) GROUP BY 1")
def t4(spark, d):
    o, l_ = table(spark, d, "orders"), table(spark, d, "lineitem").select("l_orderkey", "l_shipdate")
    return o.join(l_, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_shipdate") > F.col("o_orderdate")), "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@reg("t22_customers_without_late_orders", "SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1998-01-01')")
def t22(spark, d):
    return table(spark, d, "customer").where("c_acctbal > 0").join(table(spark, d, "orders").where("o_orderdate >= timestamp_ntz '1998-01-01 00:00:00'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@reg("t18_largest_orders", "SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3", longs=('rn',))
def t18(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("rn")).where("rn <= 3")


QUERIES, SQL = reg.queries, reg.sql
