"""Contradictions, integrity checks, novelty and knowledge gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

FAR, FAR_DAY = "9999-12-31T23:59:59Z", "9999-12-31"


def windows_overlap(a: str, b: str) -> Column:
    """Ends included; compared as text; a null start is the earliest, a null end the latest."""
    lo = lambda t: F.coalesce(F.col(f"{t}.valid_from"), F.lit(""))
    hi = lambda t: F.coalesce(F.col(f"{t}.valid_until"), F.lit(FAR))
    return (lo(a) <= hi(b)) & (lo(b) <= hi(a))


def strictly_overlap(a: str, b: str) -> Column:
    lo = lambda t: F.coalesce(F.col(f"{t}.valid_from"), F.lit(""))
    hi = lambda t: F.coalesce(F.col(f"{t}.valid_until"), F.lit(FAR_DAY))
    return (lo(a) < hi(b)) & (lo(b) < hi(a))


def contradictions(assertions: DataFrame, recorded: DataFrame | None = None) -> DataFrame:
    """(low, high, subject, predicate, description): pairs of assertions of one subject and predicate with different objects while both hold.

    Only subject and predicate meet in the join; repeated rows are folded before. The rows of the result are the contradicting pairs, so a subject of
    which much is said makes as many. recorded: (low, high) pairs known already, resolved ones too.
    """
    one = assertions.select("assertion_id", "page_id", F.lower(tx.strip(F.col("subject"))).alias("subject"), F.lower(tx.strip(F.col("predicate"))).alias("predicate"), "object_text", "valid_from", "valid_until").distinct()
    a, b = one.alias("a"), one.alias("b")
    cond = (F.col("a.subject") == F.col("b.subject")) & (F.col("a.predicate") == F.col("b.predicate")) & (F.col("a.assertion_id") < F.col("b.assertion_id")) & (F.col("a.object_text") != F.col("b.object_text"))
    out = a.join(b, cond & windows_overlap("a", "b")).select(
        F.col("a.assertion_id").alias("low"), F.col("b.assertion_id").alias("high"), F.col("a.subject").alias("subject"), F.col("a.predicate").alias("predicate"),
        tx.conflict_description(F.col("a.subject"), F.col("a.predicate"), F.col("a.object_text"), F.col("b.object_text")).alias("description"),
    )
    return out if recorded is None else out.join(recorded.select("low", "high"), ["low", "high"], "left_anti")


def overlapping_links(links: DataFrame) -> DataFrame:
    one = links.select("link_id", "from_page_id", "to_page_id", "relationship", "valid_from", "valid_until").distinct()
    a, b = one.alias("a"), one.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("from_page_id", "to_page_id", "relationship")]
    return a.join(b, same[0] & same[1] & same[2] & (F.col("a.link_id") < F.col("b.link_id")) & strictly_overlap("a", "b")).select(F.col("a.link_id").alias("low"), F.col("b.link_id").alias("high"))


def duplicate_assertions(assertions: DataFrame) -> DataFrame:
    one = assertions.select("assertion_id", "subject", "predicate", "object_text", "valid_from", "valid_until").distinct()
    a, b = one.alias("a"), one.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("subject", "predicate", "object_text")]
    return a.join(b, same[0] & same[1] & same[2] & (F.col("a.assertion_id") < F.col("b.assertion_id")) & strictly_overlap("a", "b")).select(F.col("a.assertion_id").alias("low"), F.col("b.assertion_id").alias("high"))


def dangling(rows: DataFrame, ref: str, pages: DataFrame, key: str = "page_id") -> DataFrame:
    """The rows whose non-null ref names no page."""
    return rows.where(F.col(ref).isNotNull()).join(pages.select(F.col(key).alias(ref)), ref, "left_anti")


def dangling_references(links: DataFrame, assertions: DataFrame, pages: DataFrame) -> DataFrame:
    """(problem, id): links with an end, and assertions with a page or (where they have that column) a predecessor, that doesn't exist."""
    found = [dangling(links, end, pages).select(F.lit("dangling link").alias("problem"), F.col("link_id").alias("id")) for end in ("from_page_id", "to_page_id")]
    found.append(dangling(assertions, "page_id", pages).select(F.lit("dangling assertion").alias("problem"), F.col("assertion_id").alias("id")))
    if "supersedes_id" in assertions.columns:
        known = assertions.select(F.col("assertion_id").alias("supersedes_id")).distinct()
        found.append(dangling(assertions, "supersedes_id", known, "supersedes_id").select(F.lit("dangling predecessor").alias("problem"), F.col("assertion_id").alias("id")))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.distinct()


def missing_field(required: dict[str, Column]) -> Column:
    """The name of the first required field that is null or blank; null if none is."""
    out = F.lit(None).cast("string")
    for name, c in reversed(required.items()):
        out = F.when(F.trim(F.coalesce(c, F.lit(""))) == "", name).otherwise(out)
    return out


def route_matches(matches: DataFrame, keys: list[str], id_col: str, score: str) -> DataFrame:
    """keys + (score, id_col): matches of one triple folded into one, with the best score and the smallest id; keys in lower case without blanks at the ends."""
    folded = matches.withColumns({k: F.lower(F.trim(k)) for k in keys[:-1]})
    return folded.groupBy(*keys).agg(F.max(score).alias(score), F.min(id_col).alias(id_col))


def resolve_gaps(gaps: DataFrame, answered: Column, at: Column) -> DataFrame:
    """gaps with resolved_at set where they are answered and still open; a gap resolved once keeps its time."""
    return gaps.withColumn("resolved_at", F.when(answered & F.col("resolved_at").isNull(), at).otherwise(F.col("resolved_at")))


def sweep(rows: DataFrame, since: str, now: Column, ttl_seconds: int, held: DataFrame, key: str) -> DataFrame:
    """Quarantined rows that are old enough to go and aren't held by anything that only the database has."""
    old = rows.where(F.col(since).isNotNull() & (F.timestamp_diff("SECOND", F.col(since), now) >= ttl_seconds))
    return old.join(held.select(key).distinct(), key, "left_anti")


def restore(pages: DataFrame, wanted: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(pages after taking the wanted ones (page_id) out of quarantine, those refused: their place (keys) is taken by a live page)."""
    ask = pages.join(wanted.select("page_id").distinct(), "page_id", "left_semi").where("quarantined_at is not null")
    taken = pages.where("quarantined_at is null").select(*keys).distinct()
    refused = ask.join(taken, keys, "left_semi").select("page_id")
    free_ = ask.join(taken, keys, "left_anti").groupBy(*keys).agg(F.min("page_id").alias("page_id")).select("page_id")  # one page a place
    back = pages.join(free_.withColumn("__back", F.lit(True)), "page_id", "left")
    return back.withColumn("quarantined_at", F.when(F.col("__back"), None).otherwise(F.col("quarantined_at"))).drop("__back"), refused


def resolve_contradictions(pairs: DataFrame, assertions: DataFrame, day: str) -> tuple[DataFrame, DataFrame]:
    """(low, high, kept, closed) of contradicting pairs: the more confident one is kept, then the later one; and the assertions, closed ones ending on day."""
    one = assertions.groupBy("assertion_id").agg(F.max("confidence").alias("c"))
    low, high = (one.select(F.col("assertion_id").alias(k), F.coalesce("c", F.lit(0.0)).alias(f"c_{k}")) for k in ("low", "high"))
    met = pairs.select("low", "high").join(low, "low").join(high, "high")
    first = F.col("c_low") > F.col("c_high")
    out = met.select("low", "high", F.when(first, F.col("low")).otherwise(F.col("high")).alias("kept"), F.when(first, F.col("high")).otherwise(F.col("low")).alias("closed"))
    gone = out.select(F.col("closed").alias("assertion_id")).distinct().withColumn("__gone", F.lit(True))
    after = assertions.join(gone, "assertion_id", "left")
    until = F.when(F.col("__gone"), F.least(F.coalesce("valid_until", F.lit(day)), F.lit(day))).otherwise(F.col("valid_until"))
    return out, after.withColumn("valid_until", until).drop("__gone")


def is_gap(top_score: Column) -> Column:
    """No result, or none of 0.3 or more, is a gap."""
    return F.coalesce(top_score, F.lit(0.0)) < 0.3


def gap_context(source: str, n: Column, top_score: Column) -> Column:
    return F.format_string(f"auto: {source} results=%d top=%.2f", n, F.coalesce(top_score, F.lit(0.0)))


def log_gaps(gaps: DataFrame, queries: DataFrame) -> DataFrame:
    """The queries (query_text) not yet known by hash, once each; resolved gaps stay known."""
    new = queries.select(F.sha2("query_text", 256).alias("query_hash"), "query_text").dropDuplicates(["query_hash"])
    return new.join(gaps.select("query_hash"), "query_hash", "left_anti")


def novelty(candidates: DataFrame, pages: DataFrame, key: str, text: str, threshold: float = 0.85) -> DataFrame:
    """(candidate, page, jaccard): pages that a candidate repeats, by Jaccard of lower-case words at threshold or more.

    Pairs meet on the prefix of their rarest words (prefix filtering), never all with all: sets with Jaccard t share one of their
    size - ceil(t * size) + 1 rarest words.
    """
    def bag(df: DataFrame, id_col: str, name: str) -> DataFrame:
        return df.select(F.col(id_col).alias(name), tx.words_set(F.col(text)).alias(f"{name}_w")).where(F.size(f"{name}_w") > 0)

    a, b = bag(candidates, key, "cand"), bag(pages, key, "page")
    freq = b.select(F.explode("page_w").alias("w")).groupBy("w").agg(F.count("*").alias("n"))

    def prefix(df: DataFrame, name: str) -> DataFrame:
        each = df.select(name, F.explode(f"{name}_w").alias("w"), F.size(f"{name}_w").alias("size")).join(freq, "w", "left")
        rn = F.expr(f"row_number() over (partition by {name} order by coalesce(n, 0), w)")
        return each.withColumn("rn", rn).where(F.col("rn") <= F.col("size") - F.ceil(threshold * F.col("size")) + 1).select(name, "w", "size")

    p, q = prefix(a, "cand"), prefix(b, "page").withColumnRenamed("size", "size2")
    met = p.join(q, "w").where((F.col("cand") != F.col("page")) & (F.least("size", "size2") >= threshold * F.greatest("size", "size2"))).select("cand", "page").distinct()
    both = met.join(a, "cand").join(b, "page")
    n = F.size(F.array_intersect("cand_w", "page_w"))
    j = n / (F.size("cand_w") + F.size("page_w") - n)
    return both.withColumn("jaccard", j).where(F.col("jaccard") >= threshold).select("cand", "page", "jaccard")
