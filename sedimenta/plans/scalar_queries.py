"""Queries of the scalar functions, each over a whole table, with SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.tables import table
from .registry import Registry

reg = Registry()
AS_OF = "2025-06-01"
_S = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


def _strip(c: str) -> str:
    return _S.format(c)


def simple(name: str, source: str, key: str, spark_expr, sql_expr: str) -> None:
    """One value per row of a table: value = spark_expr, checked against sql_expr."""

    def run(spark: SparkSession, d: str):
        value = spark_expr() if callable(spark_expr) else spark_expr
        return table(spark, d, source).select(F.col(key), value.alias("value"))

    run.__name__ = name
    reg(name, f"SELECT {key}, {sql_expr} AS value FROM {source}")(run)


def c(name: str) -> Column:
    return F.col(name)


simple("k01_resolve_slug", "mem_pages", "page_id", lambda: tx.resolve_slug(F.concat(F.lit(" /"), c("title"), F.lit("//x/ "))), f"regexp_replace(regexp_replace(replace(lower({_strip(chr(39) + ' /' + chr(39) + ' || title || ' + chr(39) + '//x/ ' + chr(39))}), ' ', '-'), '^/+|/+$', '', 'g'), '/+', '/', 'g')")
simple("k02_derive_wing", "mem_pages", "page_id", lambda: tx.derive_wing(c("slug")), "CASE WHEN strpos(slug, '/') > 1 THEN split_part(slug, '/', 1) ELSE 'general' END")
simple(
    "k03_derive_room", "mem_pages", "page_id", lambda: tx.derive_room(c("compiled_truth")),
    "regexp_replace(replace(lower(regexp_replace(substr(coalesce(list_filter(string_split(compiled_truth, chr(10)), lambda x: starts_with(x, '## ') AND regexp_replace(substr(x, 4), '^\\s+|\\s+$', '', 'g') <> '')[1], ''), 4), '^\\s+|\\s+$', '', 'g')), ' ', '-'), '[^a-z0-9-]', '', 'g')",
)
_FLAT = "array_to_string(list_transform(string_split(compiled_truth, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), chr(10))"
_PARA = f"replace(regexp_extract({_FLAT}, '(?:^|\\n)([^#\\n][^\\n]*(?:\\n[^#\\n][^\\n]*)*)', 1), chr(10), ' ')"
simple("k04_extract_summary", "mem_pages", "page_id", lambda: tx.extract_summary(c("compiled_truth")), f"substr(CASE WHEN {_PARA} <> '' THEN {_PARA} ELSE regexp_extract({_FLAT}, '(?:^|\\n)([^\\n]+)', 1) END, 1, 200)")
simple("k05_slug_from_path", "documents", "doc_id", lambda: tx.slug_from_path(c("rel_path")), "regexp_replace(replace(rel_path, '\\', '/'), '([^/])\\.[^./]*$', '\\1')")
_FOLDER = "lower(regexp_replace(split_part(rel_path, '/', 1), '^[0-9]+[._-]\\s*', ''))"
simple(
    "k06_type_from_folder", "documents", "doc_id", lambda: tx.type_from_folder(c("rel_path")),
    f"CASE WHEN strpos(rel_path, '/') > 0 THEN CASE {_FOLDER} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tx.FOLDER_TYPES.items()) + " END END",
)
simple("k07_strip_numeric_prefix", "documents", "doc_id", lambda: tx.strip_numeric_prefix(F.concat(c("doc_id"), F.lit("_ "), c("rel_path"))), "regexp_replace(doc_id || '_ ' || rel_path, '^[0-9]+[._-]\\s*', '')")
simple("k08_namespace_from_path", "mem_pages", "page_id", lambda: tx.namespace_from_path(F.concat(c("namespace_id"), F.lit("/extracted/"), c("slug"))), "CASE WHEN regexp_matches(regexp_extract(namespace_id || '/extracted/' || slug, '^([^/]+)/extracted/', 1), '^[A-Za-z0-9_.-]{1,128}$') THEN regexp_extract(namespace_id || '/extracted/' || slug, '^([^/]+)/extracted/', 1) ELSE '' END")
simple("k09_namespace_ok", "page_namespaces", "namespace_id", lambda: tx.namespace_ok(c("namespace_id")), "regexp_matches(namespace_id, '^[A-Za-z0-9_.-]{1,128}$')")
simple("k10_collection_name_ok", "collections", "collection_id", lambda: tx.collection_name_ok(c("coll_name")), "length(coll_name) > 0 AND NOT contains(coll_name, '::')")
simple("k11_relative_path_ok", "documents", "doc_id", lambda: tx.relative_path_ok(c("rel_path")), "NOT regexp_matches(rel_path, '(^$)|(\\x00)|(^[/\\\\])|(^[A-Za-z]:)|(//)|(/$)|((^|[/\\\\])\\.\\.([/\\\\]|$))')")
simple("k12_sha256", "mem_pages", "page_id", lambda: F.sha2(c("compiled_truth"), 256), "sha256(compiled_truth)")
_WS = "list_filter(list_distinct(string_split_regex(lower(coalesce({0}, '')), '\\s+')), lambda x: x <> '')"
_A, _B = _WS.format("summary"), _WS.format("compiled_truth")
simple(
    "k13_jaccard", "mem_pages", "page_id", lambda: F.round(tx.jaccard(F.coalesce("summary", F.lit("")), F.coalesce("compiled_truth", F.lit(""))), 9),
    f"round(CASE WHEN len({_A}) + len({_B}) = 0 THEN 1.0 ELSE len(list_intersect({_A}, {_B})) / (len({_A}) + len({_B}) - len(list_intersect({_A}, {_B}))) END, 9)",
)
simple("k14_normalise_evidence", "assertions", "assertion_id", lambda: tx.normalise_evidence(c("evidence_text")), _strip(f"regexp_replace({_strip('evidence_text')}, '[.!?;:]+$', '')"))
simple("k15_object_ok", "assertions", "assertion_id", lambda: tx.object_ok(c("object_text")), f"strlen({_strip('object_text')}) >= 6")
simple("k19_role_folder", "mem_pages", "page_id", lambda: tx.role_folder(F.lower(F.trim("page_type"))), "CASE lower(trim(page_type)) WHEN 'person' THEN 'people' WHEN 'company' THEN 'companies' WHEN 'team' THEN 'teams' ELSE lower(trim(page_type)) || 's' END")
simple("k20_canonical_surface", "assertions", "assertion_id", lambda: F.coalesce(F.nullif(tx.resolve_slug(c("subject")), F.lit("")), F.lower(F.trim("subject"))), f"coalesce(nullif(regexp_replace(regexp_replace(replace(lower({_strip('subject')}), ' ', '-'), '^/+|/+$', '', 'g'), '/+', '/', 'g'), ''), lower(trim(subject)))")
simple("k22_fact_slug", "assertions", "assertion_id", lambda: tx.fact_slug(c("predicate"), tx.fact_signature(F.lit("fact"), c("subject"), c("predicate"), c("object_text"))), "CASE WHEN regexp_replace(regexp_replace(lower(predicate), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') = '' THEN 'fact' ELSE regexp_replace(regexp_replace(lower(predicate), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') END || '-' || substr(sha256(concat_ws('|', 'fact', coalesce(subject, ''), coalesce(predicate, ''), coalesce(object_text, ''))), 1, 4)")
simple("k23_slugify", "mem_pages", "page_id", lambda: tx.slugify(c("title")), "CASE WHEN regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') = '' THEN 'fact' ELSE regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') END")
simple("k24_fact_signature", "assertions", "assertion_id", lambda: tx.fact_signature(F.lit("preference"), c("subject"), c("object_text")), "concat_ws('|', 'preference', coalesce(subject, ''), coalesce(object_text, ''))")
simple("k28_type_key", "assertions", "assertion_id", lambda: F.lower(tx.strip(c("predicate"))), f"lower({_strip('predicate')})")
simple("k29_json_field", "mem_pages", "page_id", lambda: F.get_json_object("frontmatter", "$.type"), "CASE WHEN json_valid(frontmatter) THEN json_extract_string(frontmatter, '$.type') END")
simple("k29_event_prop", "events", "event_id", lambda: F.get_json_object("props", "$.k"), "json_extract_string(props, '$.k')")
simple("k30_first_nonblank", "mem_pages", "page_id", lambda: tx.first_nonblank(c("compiled_truth"), c("summary"), c("title")), "coalesce(nullif(compiled_truth, ''), nullif(summary, ''), nullif(title, ''))")
simple("k31_add_millis", "events", "event_id", lambda: F.date_format(c("ts") + F.expr("INTERVAL 5 SECOND"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), "strftime(ts + INTERVAL 5 SECOND, '%Y-%m-%dT%H:%M:%SZ')")
simple("k32_older_than_days", "knowledge_gaps", "gap_id", lambda: c("detected_at") < F.expr(f"TIMESTAMP_NTZ '{AS_OF} 00:00:00' - INTERVAL 30 DAY"), f"detected_at < TIMESTAMP '{AS_OF} 00:00:00' - INTERVAL 30 DAY")
simple("k33_age_seconds_reached", "mem_pages", "page_id", lambda: F.timestamp_diff("SECOND", c("quarantined_at"), F.expr(f"TIMESTAMP_NTZ '{AS_OF} 00:00:00'")) >= 30 * 86400, f"date_sub('second', quarantined_at, TIMESTAMP '{AS_OF} 00:00:00') >= 30 * 86400")
simple("k34_elapsed_floor", "knowledge_gaps", "gap_id", lambda: F.greatest(F.lit(0).cast("long"), F.timestamp_diff("SECOND", c("detected_at"), c("resolved_at"))), "CASE WHEN resolved_at IS NULL OR detected_at IS NULL THEN 0 ELSE greatest(0, date_sub('second', detected_at, resolved_at)) END")
simple("k35_backoff", "mem_pages", "page_id", lambda: tx.backoff_seconds(c("page_version").cast("int") - 1), "CASE WHEN page_version - 1 <= 0 THEN 0 ELSE CAST(pow(2, least(page_version - 2, 4)) AS INTEGER) END")
simple("k36_date_of", "links", "link_id", lambda: tx.date_of(c("valid_from")), "CASE WHEN regexp_matches(substr(valid_from, 1, 10), '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN substr(valid_from, 1, 10) END")
simple("k37_conversation_path", "mem_pages", "page_id", lambda: tx.conversation_path(c("namespace_id"), F.date_format("created_at", "yyyy-MM-dd"), tx.slugify(c("title"))), "CASE WHEN namespace_id = '' THEN '' ELSE namespace_id || '/' END || 'conversations/' || strftime(created_at, '%Y-%m-%d') || '/' || CASE WHEN regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') = '' THEN 'fact' ELSE regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') END || '.md'")
simple("k38_whitespace_key", "mem_pages", "page_id", lambda: F.sha2(tx.whitespace_key(c("compiled_truth")), 256), "sha256(" + _strip("regexp_replace(compiled_truth, '\\s+', ' ', 'g')") + ")")
simple("k39_uuid_or_frontmatter", "mem_pages", "page_id", lambda: F.coalesce("uuid", F.get_json_object("frontmatter", "$.uuid"), F.concat(F.lit("page-"), c("page_id"))), "coalesce(uuid, CASE WHEN json_valid(frontmatter) THEN json_extract_string(frontmatter, '$.uuid') END, 'page-' || page_id)")
simple("k40_truncate", "mem_pages", "page_id", lambda: F.substring("title", 1, 12), "substr(title, 1, 12)")
simple("k21_conflict_description", "assertions", "assertion_id", lambda: tx.conflict_description(c("subject"), c("predicate"), c("object_text"), c("page_slug")), "subject || ' has conflicting ' || predicate || ' assertions: ' || least(object_text, page_slug) || ' vs ' || greatest(object_text, page_slug)")
simple("k45_blocklist", "mem_pages", "page_id", lambda: F.array_join(tx.blocklist(F.concat(c("title"), F.lit(",\n x , "), c("page_type"))), ";"), "array_to_string(list_filter(list_transform(string_split_regex(title || ',' || chr(10) || ' x , ' || page_type, '[\\n,]'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), ';')")
simple("j12_tags", "mem_pages", "page_id", lambda: F.array_join(tx.tags(c("frontmatter")), ";"), "CASE WHEN json_valid(frontmatter) AND json_extract(frontmatter, '$.tags') IS NOT NULL THEN array_to_string(list_filter(list_transform(CASE WHEN json_type(frontmatter, '$.tags') = 'ARRAY' THEN CAST(json_extract(frontmatter, '$.tags') AS VARCHAR[]) ELSE string_split(json_extract_string(frontmatter, '$.tags'), ',') END, lambda x: trim(x)), lambda x: x <> ''), ';') END")
simple("j10_wikilinks", "mem_pages", "page_id", lambda: F.array_join(tx.wikilinks(c("compiled_truth")), ";"), "array_to_string(list_transform(regexp_extract_all(compiled_truth, '\\[\\[([^\\[\\]]+)\\]\\]', 1), lambda x: regexp_replace(regexp_replace(replace(lower(regexp_replace(x, '^\\s+|\\s+$', '', 'g')), ' ', '-'), '^/+|/+$', '', 'g'), '/+', '/', 'g')), ';')")
simple("i06_chunk_tokens", "mem_pages", "page_id", lambda: F.greatest(F.lit(1), F.floor(F.octet_length("compiled_truth") / 4)), "CASE WHEN compiled_truth IS NULL THEN 1 ELSE greatest(1, strlen(compiled_truth) // 4) END")
simple("a03_markdown_file", "documents", "doc_id", lambda: F.lower("rel_path").endswith(".md"), "ends_with(lower(rel_path), '.md')")
simple("b19_intent_wing", "documents", "doc_id", lambda: F.nullif(F.regexp_extract("text", r"(?:^|\s)([^/\s]+)/[^\s]", 1), F.lit("")), "nullif(regexp_extract(text, '(?:^|\\s)([^/\\s]+)/[^\\s]', 1), '')")
simple("m16_queue_key", "mem_pages", "page_id", lambda: tx.queue_key(c("namespace_id"), c("slug")), "CASE WHEN namespace_id = '' THEN slug ELSE namespace_id || '::' || slug END")


def _matches(patterns: dict[str, str], spark: SparkSession, d: str):
    """(assertion_id, predicate, subject, object): every match of every pattern in the evidence of each row."""
    rows = table(spark, d, "assertions").select("assertion_id", "evidence_text").distinct()
    each = F.array(
        *(
            F.struct(
                F.lit(k).alias("predicate"),
                F.arrays_zip(F.regexp_extract_all("evidence_text", F.lit(p), F.lit(1)).alias("s"), F.regexp_extract_all("evidence_text", F.lit(p), F.lit(2)).alias("o")).alias("m"),
            )
            for k, p in patterns.items()
        )
    )
    rows = rows.select("assertion_id", F.explode(each).alias("e")).select("assertion_id", "e.predicate", F.explode("e.m").alias("m"))
    return rows.select("assertion_id", "predicate", tx.normalise_evidence(F.col("m.s")).alias("subject"), tx.normalise_evidence(F.col("m.o")).alias("object"))


def _matches_sql(patterns: dict[str, str]) -> str:
    def q(p: str) -> str:
        return p.replace("'", "''")

    n = lambda x: _strip(f"regexp_replace({_strip(x)}, '[.!?;:]+$', '')")
    parts = [
        f"SELECT assertion_id, '{k}' AS predicate, unnest(regexp_extract_all(evidence_text, '{q(p)}', 1)) AS s, unnest(regexp_extract_all(evidence_text, '{q(p)}', 2)) AS o FROM rows_"
        for k, p in patterns.items()
    ]
    return f"WITH rows_ AS (SELECT DISTINCT assertion_id, evidence_text FROM assertions), m AS ({' UNION ALL '.join(parts)}) SELECT assertion_id, predicate, {n('s')} AS subject, {n('o')} AS object FROM m"


@reg("k17_assertion_patterns", _matches_sql(tx.ASSERTION_PATTERNS))
def k17(spark, d):
    return _matches(tx.ASSERTION_PATTERNS, spark, d)


@reg("k18_entity_patterns", _matches_sql(tx.ENTITY_PATTERNS))
def k18(spark, d):
    return _matches(tx.ENTITY_PATTERNS, spark, d)


QUERIES, SQL = reg.queries, reg.sql
