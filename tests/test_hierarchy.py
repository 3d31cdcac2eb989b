import random

import pytest
from pyspark.sql import functions as F

from sedimenta.operators import hierarchy as hi
from sedimenta.operators.components import connected_components


def brute(edges):
    up = {}
    for c, p in edges:
        up.setdefault(c, set()).add(p)
    reach = {}
    for n in {x for e in edges for x in e}:
        seen, todo = set(), [n]
        while todo:
            for p in up.get(todo.pop(), ()):
                if p not in seen:
                    seen.add(p)
                    todo.append(p)
        reach[n] = seen
    cyc = {n: min(m for m in reach[n] if n in reach[m]) for n in reach if n in reach[n]}
    kept = {(c, p) for c, p in edges if c != p and not (c in cyc and p in cyc and cyc[c] == cyc[p])}
    down = {}
    for c, p in kept:
        down.setdefault(p, []).append(c)
    rows = []

    def walk(n, path):
        pre = len(rows)
        rows.append(None)
        for c in sorted(down.get(n, ())):
            walk(c, [*path, c])
        rows[pre] = (n, path[-2] if len(path) > 1 else None, path[0], len(path) - 1, tuple(path), pre, len(rows) - 1, len(rows) - 1 - pre, cyc.get(n))

    for r in sorted({x for e in edges for x in e} - {c for c, _ in kept}):
        walk(r, [r])
    return cyc, set(rows), reach


def frame(spark, edges):
    return spark.createDataFrame(list(edges), "child long, parent long")


CASES = {
    "chain": {(i + 1, i) for i in range(70)},
    "ring": {(i, (i + 1) % 13) for i in range(13)} | {(20, 3), (21, 20)},
    "two rings through one page": {(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 3), (9, 1)},
    "self": {(1, 1), (2, 1), (3, 3), (3, 2)},
    "several parents": {(3, 1), (3, 2), (4, 3), (5, 4), (5, 2), (6, 5)},
    "hot parent": {(i, 0) for i in range(1, 60)} | {(100, 5), (100, 7)},
}


@pytest.mark.parametrize("name", [*CASES, *range(4)])
def test_against_walks(spark, name):
    edges = CASES.get(name)
    if edges is None:
        rng = random.Random(name)
        edges = {(c, rng.randint(0, max(0, c - 1))) for c in range(1, 60)} | {(rng.randint(0, 59), rng.randint(0, 59)) for _ in range(6)}
    cyc, rows, _ = brute(edges)
    got = {r.node: r.cycle_id for r in hi.cycles(frame(spark, edges)).collect()}
    assert got == cyc
    if name in ("chain", "ring", "several parents", "hot parent", 1):
        out = {(r.page_id, r.parent_id, r.root_id, r.depth, tuple(r.path), r.pre, r.post, r.n_descendants, r.cycle_page_id) for r in hi.hierarchy(frame(spark, edges)).collect()}
        assert out == rows


def test_links_and_descendants(spark):
    rows = [(1, 2, " Parent "), (2, 1, "child"), (3, 2, "PARENT"), (2, 4, "child"), (None, 2, "parent"), (5, None, "child"), (7, 8, "related"), (8, 9, None)]
    df = spark.createDataFrame(rows, "from_page_id long, to_page_id long, relationship string").withColumn("child", F.lit("clash")).withColumn("size", F.lit(0))
    edges = hi.parent_edges(df)
    assert {tuple(r) for r in edges.collect()} == {(1, 2), (3, 2), (4, 2)}
    tree = hi.hierarchy(edges)
    below = hi.descendants(tree, spark.createDataFrame([(2,), (1,)], "page_id long"), block=2)
    assert {tuple(r) for r in below.collect()} == {(2, 1), (2, 3), (2, 4)}
    assert hi.cycles(edges.limit(0)).count() == 0
    assert hi.hierarchy(edges.limit(0)).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (2, 1), (7, 8), (5, 5), (None, 3), (9, 7)] + [(20, i) for i in range(21, 60)]
    out = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert out == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, **{i: 20 for i in range(20, 60)}}


def test_descendants_of_all_pages(spark, tmp_path):
    """Pages whose ids aren't divisible by 50 have their descendants listed too."""
    from __spark_entry__ import queries

    links = {(51, 50), (52, 51), (53, 51), (54, 53), (54, 52), (60, 61)}
    _, _, reach = brute(links)
    rows = [(c, p, "parent") for c, p in links]
    spark.createDataFrame(rows, "from_page_id long, to_page_id long, relationship string").write.parquet(str(tmp_path / "links.parquet"))
    out = [tuple(r) for r in queries()["p5_all_descendants"](spark, str(tmp_path)).collect()]
    assert sorted(out) == sorted((p, c) for c in reach for p in reach[c])


def test_nothing_is_lost_at_cycles(spark):
    # 1 is above the cycle 2, 3, 4; 10 hangs on 3 and leads to 11; the cycle 20, 21 stands alone; 30 is its own parent.
    edges = {(2, 1), (3, 2), (4, 3), (2, 4), (10, 3), (11, 10), (20, 21), (21, 20), (30, 30), (31, 30)}
    cyc, _, reach = brute(edges)
    expected = sorted((p, c) for c in reach for p in reach[c])
    assert sorted(tuple(r) for r in hi.whole_descendants(frame(spark, edges)).collect()) == expected
    rows = {r.page_id: r for r in hi.whole_hierarchy(frame(spark, edges)).collect()}
    assert {p: r.cycle_page_id for p, r in rows.items()} == {p: cyc.get(p) for p in reach}
    assert {p: r.n_descendants for p, r in rows.items()} == {p: sum(a == p for a, _ in expected) for p in reach}
    assert {p: tuple(rows[p].path) for p in (3, 11, 21, 31)} == {3: (1, 2), 11: (1, 2, 10, 11), 21: (20,), 31: (30, 31)}
    assert (rows[11].root_id, rows[11].parent_id, rows[11].depth, rows[4].parent_id, rows[4].pre) == (1, 10, 3, 1, rows[2].pre)


def test_many_levels_of_several_parents(spark, monkeypatch):
    """No places are lost where a path has more pages with several parents than pointer doubling takes rounds."""
    monkeypatch.setattr(hi, "MOST_ROUNDS", 4)
    edges = {(i, i - 1) for i in range(1, 7)} | {(i, 100 + i) for i in range(1, 7)}
    place = hi.places(frame(spark, edges), spark.createDataFrame([], "node long, cycle_id long"))
    assert sorted(r.page for r in place.collect()) == sorted([0, *range(101, 107), *(i for i in range(1, 7) for _ in range(i + 1))])


def test_many_pages_with_several_parents_one_below_the_other(spark):
    """80 pages, each below the one before and below a root of its own: page k has k + 1 places, and none is lost after any number of levels."""
    n = 80
    rows = [(k, k - 1) for k in range(1, n)] + [(k, 1000 + k) for k in range(n)]
    edges = spark.createDataFrame(rows, "child long, parent long")
    places = {r.page: r.n for r in hi.places(edges, hi.cycles(edges)).groupBy("page").count().withColumnRenamed("count", "n").collect()}
    assert all(places[k] == k + 1 for k in range(n)) and all(places[1000 + k] == 1 for k in range(n))


def test_a_long_cycle_of_pages_with_second_parents(spark):
    n = 3000
    rows = [(k, (k + 1) % n) for k in range(n)] + [(k, 10_000 + k) for k in range(n)] + [(20_000, 20_001), (20_001, 20_000), (20_002, 20_001), (20_003, 20_003)]
    edges = spark.createDataFrame(rows, "child long, parent long")
    want = {(k, 0) for k in range(n)} | {(20_000, 20_000), (20_001, 20_000), (20_003, 20_003)}
    assert {(r.node, r.cycle_id) for r in hi.cycles(edges).collect()} == want


def test_a_core_in_rounds_gives_what_one_task_gives(spark):
    import random

    rng = random.Random(6)
    rows = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(75)] + [(100 + k, 100 + (k + 1) % 40) for k in range(40)]
    edges = spark.createDataFrame(rows, "u long, w long").where("u <> w")
    one, many = ({(r.node, r.part) for r in hi.strong_parts(edges, size).collect()} for size in (10**6, 0))
    assert one == many and (139, 100) in one


def test_hot_keys_are_joined_apart(spark):
    from sedimenta.operators.skew import hot_join

    big = spark.range(400).selectExpr("id", "case when id % 3 = 0 then 7 else id end as k")
    small = spark.range(400).selectExpr("id as k", "id * 2 as v")
    want = sorted(map(tuple, big.join(small, "k").collect()))
    assert sorted(map(tuple, hot_join(big, small, "k", 400, few=50).select("k", "id", "v").collect())) == want
    assert sorted(map(tuple, hot_join(big, small, "k", 400).select("k", "id", "v").collect())) == want
