"""Queries that run as streams over the events table, and queries of the file-shaped functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import conversation_file as cf
from ..functions import markdown as md
from ..functions import redaction as rd
from ..functions.arrow import column_function
from ..operators import vector as ve
from ..session import materialize, ship
from ..sources.tables import table
from ..streaming import turns as st
from . import table_queries as tq
from .registry import Registry

reg = Registry()

_SESSIONS = """
WITH g AS (SELECT user_id, event_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR date_diff('microsecond', lag(ts) OVER w, ts) >= 43200000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS no FROM g), a AS (SELECT user_id, no, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM s GROUP BY 1, 2)
SELECT user_id, strftime(started, '%Y-%m-%d %H:%M:%S') AS started, n FROM a WHERE ended + INTERVAL 12 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 MINUTE"""


@reg("m05_stream_idle_close", _SESSIONS)
def m05_stream(spark, d):
    s = st.run_available(st.idle_sessions(st.read_stream(spark, f"{d}/events.parquet"), "user_id", "ts", 12 * 3600))
    return s.select("user_id", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), "n")


@reg("m08_stream_merge", tq.SQL["m08_trigger_merge"])
def m08_stream(spark, d):
    kind = F.when(F.col("event_id") % 41 == 0, "session_close").when(F.col("event_id") % 5 == 0, "manual").otherwise("debounce")
    at = F.date_format(F.col("ts") + F.expr("INTERVAL 5 SECOND"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    q = st.read_stream(spark, f"{d}/events.parquet").select("user_id", "event_id", kind.alias("kind"), at.alias("due"))
    out = st.run_available(st.pending_jobs(q, "user_id", "kind", "due", "event_id"), "update")
    return out.select("user_id", F.col("trigger").alias("kind"), F.col("at").alias("due"))


@reg("m21_stream_unseen", "SELECT DISTINCT user_id, event_type FROM events")
def m21(spark, d):
    out = st.run_available(st.unseen(st.read_stream(spark, f"{d}/events.parquet"), ["user_id", "event_type"], "ts", "400 days"))
    return out.select("user_id", "event_type")


@reg("m14_stream_batches", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def m14(spark, d):
    """Counts per batch, added up over the batches."""
    e = st.read_stream(spark, f"{d}/events.parquet").select("event_type")
    return st.run_available(e).groupBy("event_type").agg(F.count("*").alias("n"))


# --- pages, chunks and conversations as files --------------------------------------------------------------------------------


@reg("a06_parse_pages")
def a06(spark, d):
    """Fields, truth and timeline of every document as a page file."""
    t = table(spark, d, "documents").select("doc_id", "text")
    p = column_function(t, md.parse_page, md.PAGE_SCHEMA, F.col("text"))
    return t.withColumn("p", p).select("doc_id", "p.frontmatter", "p.truth", "p.timeline")


@reg("a07_split_truth", """SELECT page_id, strlen(t) AS truth_bytes FROM (SELECT page_id, regexp_replace(CASE WHEN regexp_matches(x, '(?m)^---\\r?$') THEN regexp_extract(x, '(?s)^(.*?)(?m:^---\\r?$)', 1) ELSE x END, '\\r?\\n$', '') AS t FROM (SELECT page_id, coalesce(timeline, '') AS x FROM mem_pages))""")
def a07(spark, d):
    t = table(spark, d, "mem_pages").select("page_id", F.coalesce("timeline", F.lit("")).alias("x"))
    return t.select("page_id", F.octet_length(column_function(t, lambda x: md.split_body(x)[0], "string", F.col("x"))).cast("long").alias("truth_bytes"))


@reg("a12_render_pages")
def a12(spark, d):
    t = table(spark, d, "mem_pages").select("page_id", "frontmatter", "compiled_truth", "timeline")
    return t.select("page_id", column_function(t, md.render_page, "string", F.col("frontmatter"), F.col("compiled_truth"), F.col("timeline")).alias("text"))


def _chunks(spark, d):
    t = table(spark, d, "mem_pages").select("page_id", "compiled_truth", "timeline")
    c = column_function(t, md.chunks, md.CHUNK_SCHEMA, F.col("compiled_truth"), F.col("timeline"))
    e = t.select("page_id", F.explode(c).alias("c")).select("page_id", "c.*")
    return e.withColumn("content_hash", F.sha2("content", 256)).withColumn("token_count", F.greatest(F.lit(1), F.floor(F.octet_length("content") / 4)))


@reg("i01_chunk_pages")
def i01(spark, d):
    return _chunks(spark, d).select("page_id", "chunk_index", "chunk_type", "heading_path", "content_hash", "token_count")


@reg("i02_truth_chunks")
def i02(spark, d):
    return _chunks(spark, d).where("chunk_type = 'truth_section'").groupBy("page_id").agg(F.count("*").alias("chunks"), F.max(F.octet_length("content")).alias("largest"))


@reg("i03_timeline_chunks")
def i03(spark, d):
    return _chunks(spark, d).where("chunk_type = 'timeline_entry'").select("page_id", "heading_path", "token_count")


@reg("i16_stale_embeddings")
def i16(spark, d):
    """Pages whose chunks now differ, by place, from those of the version before (here: the texts with every 'the' left out)."""
    now = materialize(_chunks(spark, d), "chunks").select("page_id", "chunk_index", F.struct("chunk_type", "content_hash", "heading_path").alias("now"))
    t = table(spark, d, "mem_pages").select("page_id", F.when(F.col("page_id") % 3 == 0, F.replace("compiled_truth", F.lit(" the "), F.lit(" "))).otherwise(F.col("compiled_truth")).alias("compiled_truth"), "timeline")
    c = column_function(t, md.chunks, md.CHUNK_SCHEMA, F.col("compiled_truth"), F.col("timeline"))
    old = t.select("page_id", F.explode(c).alias("c")).select("page_id", "c.chunk_index", F.struct("c.chunk_type", F.sha2("c.content", 256).alias("content_hash"), "c.heading_path").alias("old"))
    both = now.join(old, ["page_id", "chunk_index"], "full")
    return both.groupBy("page_id").agg(F.bool_or(~F.col("now").eqNullSafe(F.col("old"))).alias("stale"))


@reg("i10_embed_chunks")
def i10(spark, d):
    return ve.embed(_chunks(spark, d).select("page_id", "chunk_index", "content"), "content", 64).select("page_id", "chunk_index", "embedding")


@reg("k16_assertion_sections")
def k16(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.concat("text", F.lit("\n## Assertions\n- x works at y\n## Next\nz")).alias("text"))
    return t.select("doc_id", column_function(t, md.assertions_section, "string", F.col("text")).alias("section"))


def _turns(spark, d):
    t = table(spark, d, "documents").where("doc_kind = 'conversation'").select("doc_id", "text")
    return t.select("doc_id", F.explode(column_function(t, cf.parse_turns, cf.TURN_SCHEMA, F.col("text"))).alias("t")).select("doc_id", "t.*")


@reg("k25_parse_turns", "SELECT doc_id, CAST(unnest(regexp_extract_all(text, '(?:^|\\n)## Turn ([0-9]+) · (user|assistant|system|tool) · ([^\\s]+)[ \\t]*(?:\\r?\\n|$)', 1)) AS INTEGER) AS ordinal, unnest(regexp_extract_all(text, '(?:^|\\n)## Turn ([0-9]+) · (user|assistant|system|tool) · ([^\\s]+)[ \\t]*(?:\\r?\\n|$)', 2)) AS role, unnest(regexp_extract_all(text, '(?:^|\\n)## Turn ([0-9]+) · (user|assistant|system|tool) · ([^\\s]+)[ \\t]*(?:\\r?\\n|$)', 3)) AS ts FROM documents WHERE doc_kind = 'conversation'")
def k25(spark, d):
    return _turns(spark, d).select("doc_id", "ordinal", "role", "ts")


@reg("k26_render_turns")
def k26(spark, d):
    """Every conversation written again; parsing what was written gives the same turns."""
    t = table(spark, d, "documents").where("doc_kind = 'conversation'").select("doc_id", "text")

    def again(x):
        turns = cf.parse_turns(x) or []
        return cf.parse_turns(cf.render_turns(turns)) == turns

    return t.select("doc_id", column_function(t, again, "boolean", F.col("text")).alias("fixed_point"))


@reg("k27_prompts")
def k27(spark, d):
    t = table(spark, d, "documents").where("doc_kind = 'conversation'").select("doc_id", "text")

    def ask(i, x):
        turns = cf.parse_turns(x) or []
        return cf.prompt(str(i), turns[-5:], turns[-8:-5])

    return t.select("doc_id", column_function(t, ask, "string", F.col("doc_id"), F.col("text")).alias("prompt"))


@reg("k43_scrub_secrets")
def k43(spark, d):
    """Every document's paragraphs as one session: numbered tokens, and turned back again."""
    t = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    c = column_function(t, lambda x: rd.scrub_list(x.split("\n\n")), "array<struct<scrubbed:string,restored:string>>", F.col("text"))
    e = t.select("doc_id", "text", c.alias("c"))
    return e.select("doc_id", F.array_join("c.scrubbed", "\n\n").alias("scrubbed"), (F.array_join("c.restored", "\n\n") == F.col("text")).alias("restored"))


@reg("k46_parse_facts")
def k46(spark, d):
    """Facts in answers made from the assertions, some wrapped in commentary and some incomplete."""
    a = table(spark, d, "assertions").dropDuplicates(["assertion_id"])
    body = F.to_json(F.struct(F.array(F.struct(F.lit("fact").alias("kind"), F.col("subject").alias("about"), F.when(F.col("assertion_id") % 7 == 0, "").otherwise(F.col("evidence_text")).alias("summary"))).alias("facts")))
    t = a.select("assertion_id", F.when(F.col("assertion_id") % 3 == 0, F.concat(F.lit("Here it is: "), body, F.lit(" Done."))).otherwise(body).alias("answer"))
    out = column_function(t, cf.parse_facts, "struct<facts:array<string>,errors:array<string>>", F.col("answer"))
    return t.withColumn("o", out).select("assertion_id", F.size("o.facts").alias("facts"), F.size("o.errors").alias("errors"))


@reg("a13_export_paths", "SELECT page_id, coll_name || '/' || CASE WHEN namespace_id = '' THEN '' ELSE namespace_id || '/' END || slug || '.md' AS out_path FROM mem_pages LEFT JOIN collections USING (collection_id)")
def a13(spark, d):
    from ..sources.vault import export_paths

    return export_paths(table(spark, d, "mem_pages"), table(spark, d, "collections")).select("page_id", "out_path")


@reg("a19_quarantine_documents")
def a19(spark, d):
    """A JSON document of every quarantined page with its assertions and tags."""
    p = table(spark, d, "mem_pages").where("quarantined_at is not null")
    a = table(spark, d, "assertions").dropDuplicates(["assertion_id"]).join(p.select("page_id"), "page_id", "left_semi")
    kids = a.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("assertion_id", "predicate", "object_text"))).alias("assertions"))
    doc = F.to_json(F.struct("slug", "title", "compiled_truth", "timeline", "assertions"))
    return p.join(kids, "page_id", "left").select("page_id", doc.alias("document"))


@reg("a08_ingest")
def a08(spark, d):
    """Documents through the write path: parse, drop exact repeats of earlier documents, derive slug, wing, room and summary, and latest per path wins."""
    from ..functions import text as tx

    t = table(spark, d, "documents").where("text is not null")
    first = t.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    t = t.join(first, "doc_id", "left_semi").select("doc_id", "collection_id", "rel_path", "ingested_at", "text")
    p = t.withColumn("p", column_function(t, md.parse_page, md.PAGE_SCHEMA, F.col("text")))
    p = p.withColumn("slug", tx.slug_from_path(F.col("rel_path")))
    w = Window.partitionBy("collection_id", "slug").orderBy(F.col("ingested_at").desc(), F.col("doc_id").desc())
    p = p.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return p.select("doc_id", "collection_id", "slug", tx.derive_wing(F.col("slug")).alias("wing"), tx.derive_room(F.col("p.truth")).alias("room"), tx.extract_summary(F.col("p.truth")).alias("summary"), F.col("p.frontmatter").alias("frontmatter"))


QUERIES, SQL = reg.queries, reg.sql
