"""Neighbourhoods, score-propagating expansion, edge upserts and supersede chains over the page graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .scope import active_on

MOST_DEPTH, MOST_NODES, MOST_EDGES = 10, 1000, 1000


def outbound(links: DataFrame, pages: DataFrame, day: str | None) -> DataFrame:
    """(src, dst, slug, relationship, kind, link_id): links active on a day (all if None) and the supersede links of every page."""
    active = links.where(active_on(day)) if day else links
    named = pages.select(F.col("page_id").alias("dst"), "slug")
    real = active.where("from_page_id <> to_page_id").select(F.col("from_page_id").alias("src"), F.col("to_page_id").alias("dst"), "relationship", F.lit(0).alias("kind"), "link_id")
    ahead = pages.where("superseded_by is not null").select(F.col("page_id").alias("src"), F.col("superseded_by").alias("dst"), F.lit("superseded_by").alias("relationship"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("link_id"))
    back = ahead.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("supersedes").alias("relationship"), F.lit(2).alias("kind"), "link_id")
    return real.unionByName(ahead).unionByName(back).join(named, "dst")


def neighbourhood(links: DataFrame, pages: DataFrame, root: int, depth: int, day: str | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes (page_id, slug, depth, path) and edges (src, dst, relationship, link_id) around a page.

    Breadth first; within a level in the order of discovery, then kind, slug and relationship. The first way to a page is its path. At
    most MOST_NODES nodes and MOST_EDGES edges in that order, so the frontier stays small while the edges stay distributed.
    """
    out = outbound(links, pages, day)
    name = pages.where(F.col("page_id") == root).select("page_id", "slug")
    step = "array<struct<from:string,rel:string,to:string>>"
    nodes = materialize(name.select("page_id", "slug", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("rank"), F.array().cast(step).alias("path")), "nodes")
    frontier, edges = nodes, None
    for level in range(1, min(depth, MOST_DEPTH) + 1):
        near = frontier.select(F.col("page_id").alias("src"), F.col("slug").alias("src_slug"), F.col("rank").alias("src_rank"), F.col("path").alias("src_path"))
        met = materialize(out.join(F.broadcast(near), "src"), "met")  # the frontier has MOST_NODES rows at most
        seen = met.select("src", "dst", "relationship", "kind", "link_id")
        edges = seen if edges is None else edges.unionByName(seen)
        order = ["src_rank", "kind", "slug", "relationship", "link_id"]
        first = met.join(nodes.select(F.col("page_id").alias("dst")), "dst", "left_anti")
        first = first.withColumn("rn", F.row_number().over(Window.partitionBy("dst").orderBy(*order))).where("rn = 1")
        have = nodes.count()
        first = first.orderBy(*order).limit(max(0, MOST_NODES - have))
        rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)) + have
        hop = F.array(F.struct(F.col("src_slug").alias("from"), F.col("relationship").alias("rel"), F.col("slug").alias("to")))
        frontier = materialize(
            first.select(F.col("dst").alias("page_id"), "slug", F.lit(level).alias("depth"), rank.cast("long").alias("rank"), F.concat("src_path", hop).alias("path")), "nodes"
        )
        if not frontier.count():
            break
        nodes = materialize(nodes.unionByName(frontier), "nodes")
    if edges is None:
        edges = out.where("false").select("src", "dst", "relationship", "kind", "link_id")
    return nodes.drop("rank"), edges.distinct().orderBy("src", "kind", "dst", "relationship").limit(MOST_EDGES)


def expand(seeds: DataFrame, links: DataFrame, pages: DataFrame, day: str, hops: int, most: int = 50, decay: float = 0.5, collection_id: int | None = None) -> DataFrame:
    """seeds (page_id, score) -> added pages (page_id, score), best first, at most `most`.

    A page's score is its parent's times the link's weight times decay^hop, the best over all parents; the next hop goes on from the score it
    was found with first (best parent first). Superseded and quarantined pages are left out.
    """
    live = pages.where("superseded_by is null and quarantined_at is null")
    if collection_id is not None:
        live = live.where(F.col("collection_id") == collection_id)
    edge = links.where(active_on(day)).select(F.col("from_page_id").alias("src"), F.col("to_page_id").alias("dst"), "edge_weight", "link_id")
    edge = edge.join(live.select(F.col("page_id").alias("dst")), "dst", "left_semi").join(seeds.select(F.col("page_id").alias("dst")), "dst", "left_anti")
    frontier = seeds.select(F.col("page_id").alias("src"), F.col("score").alias("parent"))
    reached = None
    for hop in range(1, hops + 1):
        found = edge.join(frontier, "src").withColumn("score", F.col("parent") * F.col("edge_weight") * decay**hop)
        found = materialize(found.select("dst", "score", "parent", "src", "link_id"), "expanded")
        reached = found.select("dst", "score") if reached is None else reached.unionByName(found.select("dst", "score"))
        w = Window.partitionBy("dst").orderBy(F.col("parent").desc(), "src", "link_id")
        fresh = found.withColumn("rn", F.row_number().over(w)).where("rn = 1")
        if hop > 1:
            fresh = fresh.join(visited, "dst", "left_anti")
        visited = fresh.select("dst") if hop == 1 else visited.unionByName(fresh.select("dst"))
        frontier = fresh.select(F.col("dst").alias("src"), F.col("score").alias("parent"))
    best = reached.groupBy("dst").agg(F.max("score").alias("score"))
    return best.orderBy(F.col("score").desc(), "dst").limit(most).withColumnRenamed("dst", "page_id")


def upsert_edges(links: DataFrame, changes: DataFrame) -> DataFrame:
    """Derived links are unique by (from, to, relationship, kind), the last one wins; programmatic ones all stay."""
    both = links.withColumn("batch", F.lit(0)).unionByName(changes.withColumn("batch", F.lit(1)))
    key = ["from_page_id", "to_page_id", "relationship", "source_kind"]
    rn = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("batch").desc(), F.col("link_id").desc()))
    derived = both.where("source_kind <> 'programmatic'").withColumn("rn", rn).where("rn = 1").drop("rn")
    return derived.unionByName(both.where("source_kind = 'programmatic' or source_kind is null")).drop("batch")


def keep_first(df: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """One row per key, the one with the smallest id."""
    first = df.groupBy(*keys).agg(F.min(id_col).alias(id_col))
    return df.dropDuplicates([id_col]).join(first.select(id_col), id_col, "left_semi")


def close_link(links: DataFrame, match: Column, until: str) -> DataFrame:
    return links.withColumn("valid_until", F.when(match & F.col("valid_until").isNull(), F.lit(until)).otherwise(F.col("valid_until")))


def unlink(links: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return links.join(gone, keys, "left_anti")


def cross_reference_boost(results: DataFrame, links: DataFrame, day: str, weight: float = 0.05, cap: float = 0.15) -> DataFrame:
    """results (page_id, score) with boost: the weights of active links between the results, times weight, at most cap."""
    ids = results.select("page_id")
    inner = links.where(active_on(day)).join(ids.withColumnRenamed("page_id", "from_page_id"), "from_page_id", "left_semi")
    inner = inner.join(ids.withColumnRenamed("page_id", "to_page_id"), "to_page_id", "left_semi").where("from_page_id <> to_page_id")
    boost = inner.groupBy(F.col("to_page_id").alias("page_id")).agg(F.least(F.lit(cap), weight * F.sum("edge_weight")).alias("boost"))
    return results.join(boost, "page_id", "left").withColumn("boost", F.coalesce("boost", F.lit(0.0)))


def edge_outcomes(links: DataFrame, pages: DataFrame) -> DataFrame:
    """links with outcome: kept, unresolved (no live target) or other collection. Links whose source isn't there are left out."""
    s = pages.select(F.col("page_id").alias("from_page_id"), F.col("collection_id").alias("__cs"))
    t = pages.where("quarantined_at is null").select(F.col("page_id").alias("to_page_id"), F.col("collection_id").alias("__ct"))
    met = links.join(s, "from_page_id").join(t, "to_page_id", "left")
    outcome = F.when(F.col("__ct").isNull(), "unresolved").when(F.col("__ct") != F.col("__cs"), "other collection").otherwise("kept")
    return met.withColumn("outcome", outcome).drop("__cs", "__ct")


def mark_superseded(pages: DataFrame, successors: DataFrame) -> DataFrame:
    """pages with superseded_by set from successors (page_id, new_id), where it isn't set, and the successor is another live page of the same collection."""
    new = pages.where("superseded_by is null").select(F.col("page_id").alias("new_id"), F.col("collection_id").alias("__c"))
    good = successors.where("page_id <> new_id").join(new, "new_id").groupBy("page_id", "__c").agg(F.min("new_id").alias("__new"))
    met = pages.join(good.withColumnRenamed("__c", "collection_id"), ["page_id", "collection_id"], "left")
    return met.withColumn("superseded_by", F.coalesce("superseded_by", "__new")).drop("__new")
