import json
from datetime import datetime

import pytest

from sedimenta.api import Engine
from sedimenta.config import EngineConfig
from sedimenta.streaming import turns as st

NOW = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("vault"))
    pages = [
        (i, 1, "", f"notes/p{i}", "note", f"Title {i}", f"summary {w}", w, "- **2024-01-02** | a\n---\n- **2024-02-03** | b", '{"tags": "x, y"}', "notes", None, 1, None, NOW, NOW)
        for i, w in enumerate(["alpha beta", "alpha gamma", "delta epsilon", "running ponies", "zeta eta", "theta iota"])
    ]
    spark.createDataFrame(
        pages,
        "page_id long, collection_id long, namespace_id string, slug string, page_type string, title string, summary string, compiled_truth string, timeline string, frontmatter string, wing string, superseded_by long, page_version long, quarantined_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz",
    ).write.parquet(f"{root}/mem_pages.parquet")
    spark.createDataFrame([(1, 0, 5, "related", "", "programmatic", 0.9, None, None, NOW)], "link_id long, from_page_id long, to_page_id long, relationship string, context string, source_kind string, edge_weight double, valid_from string, valid_until string, created_at timestamp_ntz").write.parquet(f"{root}/links.parquet")
    spark.createDataFrame([(1, "main", "active", 1), (2, "old", "detached", 0)], "collection_id long, coll_name string, coll_state string, is_write_target int").write.parquet(f"{root}/collections.parquet")
    spark.createDataFrame([(1, 0, "notes/p0", "s", "p", "x", None, None), (2, 0, "notes/p0", "s", "p", "y", None, None)], "assertion_id long, page_id long, page_slug string, subject string, predicate string, object_text string, valid_from string, valid_until string").write.parquet(f"{root}/assertions.parquet")
    return Engine(spark, root, EngineConfig(embedding_width=32))


def test_search(engine):
    assert [r.slug for r in engine.search("alpha beta", 5).collect()] == ["notes/p0", "notes/p1"]
    assert [r.slug for r in engine.search("pony runs", 5).collect()] == ["notes/p3"]
    assert engine.search("AND OR", 5).count() == 0 and engine.search("", 5).count() == 0
    assert [r.slug for r in engine.search("runs OR title: 5", raw=True).collect()] == ["notes/p3", "notes/p5"]
    assert [r.slug for r in engine.search('alpha NOT beta', raw=True).collect()] == ["notes/p1"]


def test_query(engine):
    assert [(r.slug, r.score) for r in engine.query("[[notes/p2]]").collect()] == [("notes/p2", 1.0)]
    hits = engine.query("alpha beta", 3, hops=1, day="2024-06-01").collect()
    assert "notes/p0" in {r.slug for r in hits} and len(hits) == 3 and hits[0].score >= hits[1].score
    assert engine.query("   ").count() == 0
    assert engine.progressive("alpha beta", budget=40)


def test_tools(engine):
    assert engine.read_collection() == 1 and engine.read_collection("old") == 2
    with pytest.raises(LookupError):
        engine.read_collection("none")
    nodes, edges = engine.graph("notes/p0")
    assert {r.slug for r in nodes.collect()} == {"notes/p0", "notes/p5"} and edges.count() == 1
    assert engine.backlinks("notes/p5").count() == 1 and engine.check("notes/p0").count() == 1
    assert [r.day for r in engine.timeline("notes/p1").collect()] == ["2024-02-03", "2024-01-02"]
    assert engine.tags().count() == 12 and engine.validate().count() == 0


def test_pipe(engine):
    lines = ['{"tool": "get", "args": {"slug": "notes/p1"}}', "", "nonsense", '{"tool": "drop"}']
    out = [json.loads(x) for x in engine.pipe(lines)]
    assert out[0]["result"][0]["title"] == "Title 1" and "error" in out[1] and "error" in out[2] and len(out) == 3


def test_streams(spark, tmp_path):
    rows = [(i, i % 3, datetime(2024, 1, 1, 0, i * 7 % 60, 0), "debounce" if i % 4 else "manual") for i in range(30)]
    spark.createDataFrame(rows, "event_id long, k long, ts timestamp_ntz, kind string").repartition(3).write.parquet(str(tmp_path / "e"))
    s = st.read_stream(spark, str(tmp_path / "e"), 1)
    assert st.run_available(st.unseen(s, ["k"], "ts", "1 day")).count() == 3
    jobs = st.run_available(st.pending_jobs(s.selectExpr("event_id", "k", "kind", "cast(ts as string) as at"), "k", "kind", "at", "event_id"), "update")
    assert {r.trigger for r in jobs.collect()} >= {"manual"}
    seen = []
    st.for_each_batch(s, lambda df, n: seen.append(df.count()))
    assert sum(seen) == 30
