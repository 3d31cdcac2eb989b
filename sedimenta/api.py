"""The engine's surface: one method per tool, each giving a DataFrame (or a small list where a ranked top-k is what is asked for)."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import EngineConfig
from .functions import redaction
from .functions import text as tx
from .operators import graph as gr
from .operators import hybrid as hy
from .operators import hygiene as hg
from .operators import lexical as lx
from .operators import scope as sc
from .operators import sync as sy
from .operators import vector as ve
from .operators.scope import active_on
from .session import materialize
from .sources.tables import table

MOST_LISTED, LONGEST_RELATIONSHIP, MOST_TAGS, LONGEST_LINE = 1000, 64, 100, 5 * 1024 * 1024


@dataclass
class Engine:
    """A vault's tables and how to ask them. embed_query: a function from a text to a vector; the offline embedder by default."""

    spark: SparkSession
    root: str
    config: EngineConfig = field(default_factory=EngineConfig)
    embed_query: Callable[[str], list[float]] | None = None
    stemmed: bool = True
    _held: dict = field(default_factory=dict, repr=False)

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.root, name)

    @property
    def pages(self) -> DataFrame:
        return self.table("mem_pages")

    @property
    def links(self) -> DataFrame:
        return self.table("links").dropDuplicates(["link_id"])

    # --- reading ---------------------------------------------------------------------------------------------------------------

    def read_collection(self, name: str | None = None) -> int | None:
        """The named collection; else the only active one; else the write target."""
        rows = self.table("collections").select("collection_id", "coll_name", "coll_state", "is_write_target").collect()  # a fixed handful of rows
        if name is not None:
            found = [r for r in rows if r["coll_name"] == name]
            if not found:
                raise LookupError(f"there is no collection {name}")
            return found[0]["collection_id"]
        active = [r for r in rows if r["coll_state"] == "active"]
        target = active if len(active) == 1 else [r for r in rows if r["is_write_target"]]
        return target[0]["collection_id"] if target else None

    def get(self, slug: str, namespace: str = "") -> DataFrame:
        return sc.prefer_namespace(self.pages.where(F.col("slug") == slug), ["slug"], namespace)

    def list(self, wing: str | None = None, page_type: str | None = None, namespace: str | None = None, limit: int = 50) -> DataFrame:
        p = sc.apply_scope(self.pages, wing=wing, namespace=namespace, include_superseded=True, include_quarantined=True)
        p = p if page_type is None else p.where(F.col("page_type") == page_type)
        return p.orderBy(F.col("updated_at").desc(), "slug").limit(min(limit, MOST_LISTED)).select("slug", "page_type", "summary")

    def _scope(self, wing, collection_id, namespace, include_superseded) -> Callable[[DataFrame], DataFrame]:
        return lambda df: sc.apply_scope(df, wing, collection_id, namespace, include_superseded, include_quarantined=True)

    def _index(self) -> DataFrame:
        return lx.index(self.pages, "porter" if self.stemmed else "plain")

    def _postings(self) -> lx.Postings:
        """Built once an engine; refresh() after the pages change."""
        if "postings" not in self._held:
            self._held["postings"] = lx.build(self._index())
        return self._held["postings"]

    def _vectors(self) -> DataFrame:
        """(page_id, embedding) of all pages, embedded once an engine."""
        if "vectors" not in self._held:
            texts = self.pages.select("page_id", tx.first_nonblank(F.col("summary"), F.col("title")).alias("__t"))
            self._held["vectors"] = materialize(ve.embed(texts, "__t", self.config.embedding_width).select("page_id", "embedding"), "vectors")
        return self._held["vectors"]

    def refresh(self) -> None:
        self._held.clear()

    def _clauses(self, sanitized: str) -> str:
        return " ".join(lx.porter.stem(w.lower()) if self.stemmed else w for w in sanitized.split())

    def search(self, query: str, limit: int = 50, wing: str | None = None, collection_id: int | None = None, namespace: str | None = "", include_superseded: bool = False, raw: bool = False) -> DataFrame:
        """Lexical search: every word first, then any word; raw takes the expert syntax."""
        scope = self._scope(wing, collection_id, namespace, include_superseded)
        if raw:
            tree = lx.parse_raw(query, self.stemmed)
            hit = self._index().where(lx.raw_match(tree)).select("page_id")
            words = [[[w]] for w in lx.raw_words(tree)]
            scored = lx.bm25(self._postings(), words, False, lambda df: scope(df.withColumn("quarantined_at", F.lit(None).cast("timestamp"))))
            columns = ["page_id", "slug", "title", "summary", "wing"]
            found = scope(self._postings().docs).join(hit, "page_id", "left_semi").select(*columns).join(scored.select("page_id", "score"), "page_id", "left")
            return lx.top(found.withColumn("score", F.coalesce("score", F.lit(0.0))), limit)
        clean = lx.sanitize(query)
        if not clean or lx.only_operators(clean):
            clean = ""
        return lx.tiered(self._postings(), self._clauses(clean), limit, lambda df: scope(df.withColumn("quarantined_at", F.lit(None).cast("timestamp"))))

    def vector_search(self, query: str, limit: int = 10, wing: str | None = None, collection_id: int | None = None, namespace: str | None = "", include_superseded: bool = False) -> DataFrame:
        if not query.strip() or limit <= 0:
            return self.pages.where("false").select("page_id", "slug", F.lit(0.0).alias("score"))
        live = sc.apply_scope(self.pages, wing, collection_id, namespace, include_superseded).select("page_id", "slug", "title", "summary")
        width = self.config.embedding_width
        vec = self.embed_query(query) if self.embed_query else ve.shim_embedding(query.strip(), width).tolist()
        scored = ve.score_against(self._vectors().join(live.select("page_id"), "page_id", "left_semi"), vec)
        return ve.best_chunk(scored, "page_id").join(live, "page_id").orderBy(F.col("score").desc(), "page_id").limit(max(limit, 0))

    def query(self, text: str, limit: int = 10, wing: str | None = None, collection_id: int | None = None, namespace: str | None = "", include_superseded: bool = False, day: str | None = None, hops: int | None = None) -> DataFrame:
        """Hybrid search: exact slug, else both arms, fusion, per-page limit, floor, graph expansion."""
        if slug := sc.exact_slug(text):
            hit = sc.apply_scope(self.pages, wing, collection_id, namespace, include_superseded).where(F.col("slug") == slug)
            if hit.limit(1).count():
                return sc.prefer_namespace(hit, ["slug"], namespace or "").select("page_id", "slug", F.lit(1.0).alias("score"))
        depth = min(max(limit, 10), 200)
        args = dict(wing=wing, collection_id=collection_id, namespace=namespace, include_superseded=include_superseded)
        lex, vec = self.search(text, depth, **args).select("page_id", "score"), self.vector_search(text, depth, **args).select("page_id", "score")
        vec = sc.floor(vec, min(max(self.config.relevance_floor, 0.0), 1.0))
        out = hy.union(lex, vec, "page_id") if self.config.merge_strategy == "set-union" else hy.reciprocal_ranks([lex, vec], "page_id")
        out = sc.floor(out, self.config.relevance_floor).join(self.pages.select("page_id", "slug"), "page_id").select("page_id", "slug", "score")
        out = out.orderBy(F.col("score").desc(), "slug", "page_id").limit(depth)
        steps = self.config.graph_depth if hops is None else hops
        if steps and day:
            more = gr.expand(out, self.links, self.pages, day, steps, self.config.graph_max_added, self.config.graph_decay, collection_id)
            out = out.unionByName(more.join(self.pages.select("page_id", "slug"), "page_id").select("page_id", "slug", "score"))
        return out.orderBy(F.col("score").desc(), "slug").limit(limit)

    def progressive(self, text: str, budget: int = 4000, **kw) -> list[tuple]:
        """A ranked top-k cut to a token budget: rows that don't fit are passed over."""
        cost = F.floor((F.length(F.coalesce("compiled_truth", F.lit(""))) + F.length(F.coalesce("timeline", F.lit("")))) / 4).alias("cost")
        hits = self.query(text, **kw).join(self.pages.select("page_id", cost), "page_id").orderBy(F.col("score").desc(), "slug")
        return hy.fill_budget([(r["slug"], r["score"], r["cost"]) for r in hits.collect()], 2, budget)

    # --- graph -----------------------------------------------------------------------------------------------------------------

    def graph(self, slug: str, depth: int = 1, day: str | None = None) -> tuple[DataFrame, DataFrame]:
        root = self.pages.where(F.col("slug") == slug).select("page_id").first()
        if root is None:
            raise LookupError(f"there is no page {slug}")
        return gr.neighbourhood(self.links, self.pages, root["page_id"], depth, day)

    def backlinks(self, slug: str, day: str | None = None, limit: int = 100) -> DataFrame:
        target = self.pages.where(F.col("slug") == slug).select(F.col("page_id").alias("to_page_id"))
        found = self.links.join(target, "to_page_id", "left_semi")
        found = found.where(active_on(day)) if day else found
        return found.orderBy(F.col("created_at").desc(), "link_id").limit(limit)

    def link(self, changes: DataFrame) -> DataFrame:
        """All links after the changes (columns of links)."""
        long = changes.where(F.length("relationship") > LONGEST_RELATIONSHIP).limit(1).count()
        if long:
            raise ValueError("a relationship is too long")
        return gr.upsert_edges(self.links, changes)

    def put(self, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(pages after the changes, conflicts)."""
        return sy.upsert(self.pages, changes, ["collection_id", "namespace_id", "slug"])

    # --- hygiene ---------------------------------------------------------------------------------------------------------------

    def check(self, slug: str | None = None) -> DataFrame:
        found = hg.contradictions(self.table("assertions"))
        if slug is None:
            return found
        ids = self.table("assertions").where(F.col("page_slug") == slug).select("assertion_id").distinct()
        low = found.join(ids.withColumnRenamed("assertion_id", "low"), "low", "left_semi")
        return low.unionByName(found.join(ids.withColumnRenamed("assertion_id", "high"), "high", "left_semi"), allowMissingColumns=True).distinct()

    def validate(self) -> DataFrame:
        a = hg.overlapping_links(self.links).select(F.lit("overlapping links").alias("problem"), F.col("low").alias("id"))
        b = hg.dangling_references(self.links, self.table("assertions"), self.pages)
        c = hg.duplicate_assertions(self.table("assertions")).select(F.lit("duplicate assertion").alias("problem"), F.col("low").alias("id"))
        return a.unionByName(b).unionByName(c)

    def gaps(self, resolved: bool = False, limit: int = 50) -> DataFrame:
        g = self.table("knowledge_gaps").dropDuplicates(["gap_id"])
        g = g if resolved else g.where("resolved_at is null")
        return g.orderBy(F.col("detected_at").desc(), "gap_id").limit(limit)

    def tags(self) -> DataFrame:
        return self.pages.select("page_id", F.explode(tx.tags(F.col("frontmatter"))).alias("tag")).distinct()

    def timeline(self, slug: str, limit: int = 20) -> DataFrame:
        p = self.pages.where(F.col("slug") == slug)
        e = p.select(F.explode(F.filter(F.split("timeline", r"(?m)^---[ \t]*$"), lambda x: F.trim(x) != "")).alias("entry"))
        return e.withColumn("day", F.regexp_extract("entry", r"\*\*([0-9]{4}-[0-9]{2}(?:-[0-9]{2})?)\*\*", 1)).orderBy(F.col("day").desc(), "entry").limit(limit)

    def stats(self) -> DataFrame:
        out = None
        for name in ("mem_pages", "links", "assertions", "knowledge_gaps", "embeddings"):
            n = self.table(name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
            out = n if out is None else out.unionByName(n)
        return out

    def collections(self) -> DataFrame:
        n = self.pages.where("quarantined_at is null").groupBy("collection_id").agg(F.count("*").alias("pages"))
        return self.table("collections").join(n, "collection_id", "left").withColumn("pages", F.coalesce("pages", F.lit(0)))

    def namespaces(self) -> DataFrame:
        return self.table("page_namespaces").orderBy("created_at", "namespace_id")

    def scrub(self, session: redaction.Session, rows: Iterable[str]) -> list[str]:
        return [session.scrub(t) for t in rows]

    # --- command stream --------------------------------------------------------------------------------------------------------

    TOOLS = ("get", "list", "search", "vector_search", "query", "backlinks", "check", "validate", "gaps", "tags", "timeline", "stats", "collections", "namespaces")

    def call(self, name: str, args: dict) -> list[dict]:
        """A tool by name, its rows as dictionaries (tools give ranked or listed results of bounded length)."""
        if name not in self.TOOLS:
            raise LookupError(f"there is no tool {name}")
        rows = getattr(self, name)(**args).toJSON().take(MOST_LISTED + 1)
        if len(rows) > MOST_LISTED:
            raise OverflowError(f"{name} has more than {MOST_LISTED} rows: ask for its table instead")
        return [json.loads(r) for r in rows]

    def pipe(self, lines: Iterable[str]) -> Iterator[str]:
        """One JSON call a line in, one JSON result a line out; a line that fails gives its error and doesn't end the stream."""
        for line in lines:
            if not line.strip():
                continue
            try:
                if len(line.encode()) > LONGEST_LINE:
                    raise ValueError("the line is too long")
                c = json.loads(line)
                yield json.dumps({"result": self.call(c["tool"], c.get("args", {}))}, default=str)
            except Exception as e:
                yield json.dumps({"error": f"{type(e).__name__}: {e}"})
