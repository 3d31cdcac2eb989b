"""Queries over the vault's texts, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import leakage, neardup, packing, pii, spam, splitting


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, field_name, value): both long fields of every page, one row each."""
    pages = table(spark, sf_dir, "mem_pages")
    pair = [F.struct(F.lit(n).alias("field_name"), F.col(n).alias("value")) for n in ("compiled_truth", "timeline")]
    return pages.select("page_id", F.explode(F.array(*pair)).alias("f")).select("page_id", "f.field_name", "f.value")


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(_fields(spark, sf_dir), ["page_id", "field_name"], "value")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields that came out in pieces."""
    return p1_pieces(spark, sf_dir).where("n_pieces > 1").select("page_id", "field_name").distinct()


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    used = p6_containers(spark, sf_dir).where("container_id is not null").agg(F.countDistinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    return used.withColumn("fill", F.round(F.col("n_tokens") / (F.col("n_containers") * packing.CAPACITY), 6))


def _page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text): compiled_truth, or summary where that is null or blank."""
    blank = "compiled_truth is null or trim(regexp_replace(compiled_truth, '[\\\\s\\\\p{Z}]', ' ')) = ''"
    pages = table(spark, sf_dir, "mem_pages")
    return pages.select(F.col("page_id").alias("id"), F.expr(f"case when {blank} then summary else compiled_truth end").alias("text"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _page_texts(spark, sf_dir)
    links, members = neardup.near_duplicates(texts)
    pairs = neardup.all_pairs(links, members, texts)
    return pairs.select(F.col("a").alias("page_id_a"), F.col("b").alias("page_id_b"))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _page_texts(spark, sf_dir)
    links, members = neardup.near_duplicates(texts)
    out = neardup.groups(texts, links, members)
    return out.withColumnRenamed("id", "page_id")


def p3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links between representatives of classes of copies; p3_groups has the membership."""
    links, _ = neardup.near_duplicates(_page_texts(spark, sf_dir))
    return links.select(F.col("a").alias("class_id_a"), F.col("b").alias("class_id_b"), F.round("similarity", 6).alias("similarity"))


_FIELD = ["record_table", "record_id", "field_name"]


def _free_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_table, record_id, field_name, value) of the free-text fields of knowledge_gaps and mem_pages."""

    def fields(name: str, key: str, columns: list[str]) -> DataFrame:
        each = F.explode(F.array(*(F.struct(F.lit(c).alias("field_name"), F.col(c).alias("value")) for c in columns)))
        rows = table(spark, sf_dir, name).select(F.lit(name).alias("record_table"), F.col(key).alias("record_id"), each.alias("f"))
        return rows.select("record_table", "record_id", "f.field_name", "f.value")

    return fields("knowledge_gaps", "gap_id", ["query_text", "redacted_query"]).unionByName(fields("mem_pages", "page_id", ["compiled_truth"]))


_PERSON = "slug like 'people/%' or lower(trim(page_type)) in ('person', 'people')"


def _pii_spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, dict]:
    """The texts, all proposed spans, and the model fitted on them."""
    texts = _free_texts(spark, sf_dir)
    spans = pii.propose(texts, _FIELD, "value", pii.names(table(spark, sf_dir, "mem_pages"), "title", _PERSON), pii.common_words(texts, "value"))
    return texts, spans, pii.fit(spans)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, spans, model = _pii_spans(spark, sf_dir)
    return pii.accept(spans, model).select(*_FIELD, F.col("kind").alias("pii_kind")).distinct()


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, spans, model = _pii_spans(spark, sf_dir)
    return pii.redact(texts, _FIELD, "value", pii.accept(spans, model)).where("redacted is not null")


def p4_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vote pattern and shape with its spans, the classifier's probability, and whether it is taken."""
    _, spans, model = _pii_spans(spark, sf_dir)
    scores = spark.createDataFrame([(*k, p) for k, p in model.items()], "kind string, votes string, shape string, p double")
    counts = spans.groupBy("kind", "votes", "shape").agg(F.count("*").alias("n_spans"))
    return counts.join(F.broadcast(scores), ["kind", "votes", "shape"]).select("kind", "votes", "shape", "n_spans", F.round("p", 6).alias("p"), (F.col("p") >= pii.ACCEPT).alias("taken"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair with a common stretch or a close passage, and what it amounts to."""
    pairs = leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    pairs = pairs.groupBy("doc_id", "item_id").agg(F.max("coverage").alias("coverage"), F.max("cosine").alias("cosine"), F.max("answer_found").alias("answer_found"))
    verdict = F.when(F.col("coverage") >= leakage.COVER, "leak").when((F.col("cosine") >= leakage.PARAPHRASE) & F.col("answer_found"), "paraphrase").otherwise("partial")
    return pairs.withColumn("verdict", verdict)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return leakage.leaks(pairs).select("doc_id", "item_id").distinct()


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spam.score_documents(spam.score_blocks(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_words", *(F.round(c, 4).alias(c) for c in ("stuffed_share", "relative", "sentences")), "flagged")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.score_documents(spam.score_blocks(table(spark, sf_dir, "documents"))).where("flagged").select("doc_id")


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces, "p3_found": p3_found, "p3_groups": p3_groups, "p3_links": p3_links, "p4_found": p4_found, "p4_redacted": p4_redacted, "p4_model": p4_model, "p6_containers": p6_containers, "p6_fill": p6_fill, "p7_found": p7_found, "p7_report": p7_report, "p8_found": p8_found, "p8_scores": p8_scores}

SQL = {
    "p1_found": """
SELECT DISTINCT page_id, field_name FROM (
  SELECT page_id, 'compiled_truth' AS field_name, compiled_truth AS value FROM mem_pages
  UNION ALL SELECT page_id, 'timeline', timeline FROM mem_pages
) WHERE strlen(value) > 1920""",
}
