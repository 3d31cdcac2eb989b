import pytest
from pyspark.sql import functions as F

from sedimenta.operators import graph as gr
from sedimenta.operators import hygiene as hg
from sedimenta.operators import lexical as lx
from sedimenta.operators import sync as sy
from sedimenta.sources.vault import write_files


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_rotation_expiry_and_replacement(spark):
    t = spark.createDataFrame([(1, "a", 1, 5), (2, "a", 2, None), (3, "b", 1, 900), (4, None, 1, 901), (4, None, 1, 901)], "id long, k string, at int, age int")
    assert {(r.id, r.is_active) for r in sy.rotate(t, ["k"], "id", "at", "id").collect()} == {(1, False), (2, True), (3, True), (4, True)}
    assert rows(sy.expired(t, F.col("id") == 3, F.col("age"), 4).select("id").distinct()) == [(1,), (4,)]
    new = spark.createDataFrame([(1, "z", 9, 9)], t.schema)
    assert rows(sy.replace_rows(t, t.where("id < 3"), new, "id").select("id", "k")) == [(1, "z"), (3, "b"), (4, None), (4, None)]
    assert rows(sy.put_all(t.where("id < 3"), new, ["id"]).select("id", "k")) == [(1, "z"), (2, "a")]
    assert sy.rotate(t.limit(0), ["k"], "id", "at").count() == 0


def test_completion_checks_the_attempt(spark):
    jobs = spark.createDataFrame([(1, 1, "running"), (2, 3, "running"), (3, 1, "running"), (4, 1, "done"), (5, 2, "running")], "job_id long, attempts int, state string")
    reports = spark.createDataFrame([(1, 1, True), (1, 1, False), (2, 3, False), (3, 0, True), (4, 1, False), (5, 2, True), (5, 2, True)], "job_id long, attempts int, ok boolean")
    after, refused = sy.complete(jobs, reports, 3)
    assert rows(after.select("job_id", "state")) == [(1, "pending"), (2, "failed"), (3, "running"), (4, "done"), (5, "done")]
    assert rows(refused.select("job_id")) == [(3,), (4,)]


def test_resolution_restoring_and_marks(spark):
    a = spark.createDataFrame([(1, 0.9, None), (2, 0.5, "2024-01-01"), (2, 0.5, "2024-01-01"), (3, None, None)], "assertion_id long, confidence double, valid_until string")
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "low long, high long")
    out, after = hg.resolve_contradictions(pairs, a, "2025-01-01")
    assert rows(out) == [(1, 2, 1, 2), (2, 3, 2, 3)]
    assert {(r.assertion_id, r.valid_until) for r in after.collect()} == {(1, None), (2, "2024-01-01"), (3, "2025-01-01")}
    p = spark.createDataFrame([(1, "a", None), (2, "a", "x"), (3, "b", "x"), (4, "b", "x"), (5, "c", "x")], "page_id long, slug string, quarantined_at string")
    back, refused = hg.restore(p, p.where("page_id < 5"), ["slug"])
    assert {r.page_id for r in back.where("quarantined_at is null").collect()} == {1, 3} and rows(refused) == [(2,)]
    g = spark.createDataFrame([(1, 1, None), (2, 1, None), (3, 2, None), (4, 1, 2)], "page_id long, collection_id long, superseded_by long")
    s = spark.createDataFrame([(1, 2), (1, 3), (2, 2), (4, 1), (3, 99)], "page_id long, new_id long")
    assert {(r.page_id, r.superseded_by) for r in gr.mark_superseded(g, s).collect()} == {(1, 2), (2, None), (3, None), (4, 2)}


def test_only_operators_and_audit(spark):
    q = spark.createDataFrame([("AND OR",), ("and",), ("",), (None,), ('"NOT"',), ("NEARBY",)], "q string")
    assert [r[0] for r in q.select(lx.is_only_operators(F.col("q"))).collect()] == [True, False, False, None, True, False]
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None), (4, "z")], "k long, d string")
    b = spark.createDataFrame([(1, "x"), (2, "n"), (3, None)], "k long, d string")
    assert rows(sy.audit(a, b, "k", "d")) == [(1, "intact"), (2, "changed"), (3, "intact"), (4, "missing")]


def test_dangling_references(spark):
    p = spark.createDataFrame([(1,), (2,)], "page_id long")
    l_ = spark.createDataFrame([(1, 1, 2), (2, 9, 2), (3, 1, 8), (3, 1, 8), (4, None, 1)], "link_id long, from_page_id long, to_page_id long")
    a = spark.createDataFrame([(1, 1, None), (2, 7, 1), (3, 2, 99)], "assertion_id long, page_id long, supersedes_id long")
    assert rows(hg.dangling_references(l_, a, p)) == [("dangling assertion", 2), ("dangling link", 2), ("dangling link", 3), ("dangling predecessor", 3)]


def test_files_stay_in_their_folder(spark, tmp_path):
    ok = spark.createDataFrame([("a/b.md", "x")], "out_path string, text string")
    write_files(ok, str(tmp_path))
    assert (tmp_path / "a" / "b.md").read_text() == "x"
    with pytest.raises(Exception):
        write_files(spark.createDataFrame([("../b.md", "x")], ok.schema), str(tmp_path / "a"))
