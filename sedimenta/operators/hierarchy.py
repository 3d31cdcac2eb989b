"""Hierarchies of unknown depth from parent links: cycles, and nested-set ranges of every page's place in its tree.

Trees are not walked level by level. Where a page's only parent leads on to another page with one parent, and so on, pointers are
doubled: after k rounds a pointer spans 2^k levels, so a hierarchy of depth d takes log2(d) rounds. Pages with several parents
are what remains; the ways up through them are joined end to end, doubling too. A page has a place for every way up to a root.

Cycles. The upward pass sends every page to the first page above it that has no parent or several. Pages that never arrive are left
unprocessed: they are on or below a cycle of only children. Between the pages with several parents, pages that nothing left leads to, or
from, are processed from above and from below until none is; those left unprocessed reveal the remaining cycles, and their strongly
connected parts tell the cycles apart.

Ranges. hierarchy() leaves links within a cycle out, so that what remains has no cycle; what lies below a cycle's other pages is then
missing from each of its pages and from all above it. whole_hierarchy() and whole_descendants() lose nothing: every cycle is folded to
its smallest page first, and all its pages share that page's places. A page with several parents has a place under each of them.
Subtree sizes are summed upward; siblings get consecutive preorder ranges by prefix sums of their sizes; ranges are added up
downward. The descendants of a place are then the places numbered from pre + 1 to post, its ancestors those whose range
holds it. Sums over siblings are taken over a range-sorted table with carried totals, so a page with a third of all children
is no single task's work.

Defined results
* null ends are no link; repeated links count once; a page that is its own parent is a cycle of one.
* pages without a parent link of either kind are in no hierarchy and don't appear.
* a page on a cycle without a parent outside it is the root of its tree; an empty table gives an empty result.
* siblings are in order of their ids; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import free, materialize, measured, ship, shuffle_parts
from .skew import hot_join

MOST_ROUNDS = 64


def parent_edges(links: DataFrame) -> DataFrame:
    """(child, parent), distinct, from rows of the relationships parent (from is the child) and child (to is the child)."""
    rel = F.lower(F.regexp_replace("relationship", r"^\s+|\s+$", ""))
    up = links.where(rel == "parent").select(F.col("from_page_id").alias("child"), F.col("to_page_id").alias("parent"))
    down = links.where(rel == "child").select(F.col("to_page_id").alias("child"), F.col("from_page_id").alias("parent"))
    return up.unionByName(down).where("child is not null and parent is not null").distinct()


def _climb(single: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """single: (v, a), each page's only parent. -> (v, a, open, least), and the table of each round.

    a: the first page above v that isn't in single; open: there is none, the walk goes round, and a is a page on the cycle.
    least: of the pages from v up to a.
    """
    sums = {"n": F.count_if("open"), "s": F.sum(F.when(F.col("open"), F.col("least"))), "h": F.bit_xor(F.when(F.col("open"), F.xxhash64("v", "a")))}
    held = single.select(F.col("v").alias("a"), F.lit(True).alias("open"))
    now = single.join(held, "a", "left").select("v", "a", F.coalesce("open", F.lit(False)).alias("open"), F.col("v").alias("least"))
    (now, row), rounds, mark = measured(now, "climb", all=F.count("*"), **sums), [], None
    n_rows = row["all"]
    for _ in range(MOST_ROUNDS):  # pointers span 2^k pages: 64 rounds are more than any table has
        rounds.append(now)
        ring = (row["n"], row["s"])
        if not row["n"] or ring == mark:
            return now, rounds
        mark = ring
        there = now.select(F.col("v").alias("a"), F.col("a").alias("a2"), F.col("open").alias("open2"), F.col("least").alias("least2"))
        moving = hot_join(now.where("open"), there, "a", n_rows).select("v", F.col("a2").alias("a"), F.col("open2").alias("open"), F.least("least", "least2").alias("least"))
        now, row = measured(moving.unionByName(now.where("not open")), "climb", **sums)
    raise RuntimeError("the hierarchy is too deep")


def unprocessed(u: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """Which links (u, w) between n nodes are left when nodes that nothing (left) leads to, or from, are processed and taken out."""
    left = np.ones(len(u), bool)
    for a, b in ((u, w), (w, u)):  # downward and upward
        order = np.argsort(a, kind="stable")
        at = np.searchsorted(a[order], np.arange(n + 1))
        waits = np.bincount(b[left], minlength=n)
        ready = np.flatnonzero(waits == 0)
        while len(ready):
            size = at[ready + 1] - at[ready]
            e = order[np.repeat(at[ready], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
            e = e[left[e]]
            left[e] = False
            np.subtract.at(waits, b[e], 1)
            ready = np.unique(b[e])
            ready = ready[waits[ready] == 0]
    return left


def _parts_in_one(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links (u, w) of a small core -> (node, part): what the passes leave unprocessed, in strongly connected parts."""
    held = [(b["u"].to_numpy(), b["w"].to_numpy()) for b in it if b.num_rows]
    if not held:
        return
    u, w = (np.concatenate(x) for x in zip(*held))
    ids, both = np.unique(np.concatenate([u, w]), return_inverse=True)
    u, w = both[: len(u)], both[len(u) :]
    own = np.unique(u[u == w])
    left = unprocessed(u, w, len(ids)) & (u != w)
    order = np.argsort(u[left], kind="stable")
    to = w[left][order]
    at = np.searchsorted(u[left][order], np.arange(len(ids) + 1)).tolist()
    to = to.tolist()
    part = np.full(len(ids), -1)
    number, low, held_at, count = [0] * len(ids), [0] * len(ids), [False] * len(ids), 0
    stack: list[int] = []
    for root in np.unique(u[left]).tolist():  # depth first, without recursion
        if number[root]:
            continue
        count += 1
        number[root] = low[root] = count
        stack.append(root)
        held_at[root] = True
        path = [(root, at[root])]
        while path:
            v, k = path.pop()
            if k < at[v + 1]:
                path.append((v, k + 1))
                x = to[k]
                if not number[x]:
                    count += 1
                    number[x] = low[x] = count
                    stack.append(x)
                    held_at[x] = True
                    path.append((x, at[x]))
                elif held_at[x]:
                    low[v] = min(low[v], number[x])
                continue
            if low[v] == number[v]:
                members = []
                while True:
                    x = stack.pop()
                    held_at[x] = False
                    members.append(x)
                    if x == v:
                        break
                if len(members) > 1:
                    part[members] = min(members)
            if path:
                low[path[-1][0]] = min(low[path[-1][0]], low[v])
    part[own] = np.where(part[own] < 0, own, part[own])
    on = np.flatnonzero(part >= 0)
    yield pa.RecordBatch.from_arrays([pa.array(ids[on]), pa.array(ids[part[on]])], ["node", "part"])


def _least_reaching(edges: DataFrame, n_rows: int) -> DataFrame:
    """edges (u, w) within groups c -> (node, c, r): the node of smallest rank that reaches each node, itself included.

    Ranks are hashes. A node takes the best of its predecessors', and of its own's own (a short cut: what reaches the node that reaches it),
    so that the distance looked back doubles, and rounds follow the logarithm of the longest way.
    """
    best = F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("n"))
    nodes = edges.select(F.explode(F.array("u", "w")).alias("node"), "c").distinct()
    now, row = measured(nodes.select("node", "c", best.alias("r")), "reach", x=F.bit_xor(F.xxhash64("node", "r")))
    while True:
        mine = now.select(F.col("node").alias("u"), "r")
        sent = hot_join(edges.select("u", "w"), mine, "u", n_rows).select(F.col("w").alias("node"), "r")
        own = now.select("node", F.col("r.n").alias("via"))
        short = hot_join(own, now.select(F.col("node").alias("via"), "r"), "via", n_rows).select("node", "r")
        grown = now.select("node", "r").unionByName(sent).unionByName(short).groupBy("node").agg(F.min("r").alias("r"))
        after, seen = measured(now.select("node", "c").join(grown, "node"), "reach", x=F.bit_xor(F.xxhash64("node", "r")))
        free(now)
        now = after
        if seen == row:
            return now.select("node", "c", F.col("r.n").alias("r"))
        row = seen


#: Links of a core up to which one task solves it; a larger one is solved in rounds across the cluster, with the same result.
CORE_EDGES = 500_000


def strong_parts(edges: DataFrame, one_task: int = CORE_EDGES) -> DataFrame:
    """(node, part): the nodes of edges (u, w) that lie on a cycle; part: the smallest node of the strongly connected part.

    A core of at most one_task links is one task's work. A larger one: every node takes the node of smallest rank that reaches it; within
    those that took the same one, the nodes that reach it in turn form its part. Parts found are taken out, links between groups too, and the
    rest goes on.
    """
    ship(edges.sparkSession)
    core, row = measured(edges.distinct(), "core", n=F.count("*"))
    done = None
    core = core.withColumn("c", F.lit(0).cast("long"))
    while row["n"] > one_task:
        n_rows = row["n"]
        down = _least_reaching(core, n_rows)
        c = lambda end: down.select(F.col("node").alias(end), F.col("r").alias(f"c{end}"))
        inside = core.select("u", "w").join(c("u"), "u").join(c("w"), "w").where("cu = cw").select("u", "w", F.col("cu").alias("c"))
        inside = materialize(inside, "inside")
        up = _least_reaching(inside.select(F.col("w").alias("u"), F.col("u").alias("w"), "c"), n_rows)
        # c has the smallest rank of its group, so a node reaches it if it is the smallest it reaches.
        found = materialize(up.where("r = c").select("node", "c"), "found")
        on = inside.join(found.select(F.col("node").alias("u")), "u", "left_semi").join(found.select(F.col("node").alias("w")), "w", "left_semi")
        part = on.select(F.explode(F.array("u", "w")).alias("node"), "c").distinct()
        least = part.groupBy("c").agg(F.min("node").alias("part"))
        part = materialize(part.join(least, "c").select("node", "part"), "parts")
        done = part if done is None else done.unionByName(part)
        gone = found.select("node")
        rest = inside.join(gone.withColumnRenamed("node", "u"), "u", "left_anti").join(gone.withColumnRenamed("node", "w"), "w", "left_anti")
        core, row = measured(rest.select("u", "w", "c"), "core", n=F.count("*"))
    last = core.select("u", "w").coalesce(1).mapInArrow(_parts_in_one, "node long, part long")
    return materialize(last if done is None else done.unionByName(last), "parts")


def cycles(edges: DataFrame) -> DataFrame:
    """(node, cycle_id): every page that reaches itself, with the smallest page of those it reaches and is reached by."""
    edges = materialize(edges, "edges")
    loops = edges.where("child = parent").select(F.col("child").alias("node"), F.col("child").alias("label"))
    plain = edges.where("child <> parent")
    count = plain.groupBy("child").agg(F.count("*").alias("n"))
    counted = materialize(plain.join(count, "child"), "counted")
    top, rounds = _climb(counted.where("n = 1").select(F.col("child").alias("v"), F.col("parent").alias("a")))
    # Cycles of only children: the last pointers of those who never arrive fall on all pages of the cycles, and on no others.
    ring = top.where("open").select(F.col("a").alias("v")).distinct()
    rings = top.join(ring, "v", "left_semi").select(F.col("v").alias("node"), F.col("least").alias("label"))
    # The graph between pages with several parents: via is the parent through which the walk goes up to the next such page.
    many = counted.where("n > 1").select(F.col("child").alias("u"), F.col("parent").alias("via"))
    ends = top.where("not open").select(F.col("v").alias("via"), F.col("a").alias("w"))
    walk = many.join(ends, "via", "left").select("u", "via", F.coalesce("w", "via").alias("w"))
    unfinished = top.where("open").select(F.col("v").alias("via"))
    walk = walk.join(unfinished, "via", "left_anti").join(many.select(F.col("u").alias("w")).distinct(), "w", "left_semi")
    walk = materialize(walk.select("u", "via", "w"), "walk")
    parts = strong_parts(walk.select("u", "w"))
    pu = parts.select(F.col("node").alias("u"), F.col("part").alias("label"))
    pw = parts.select(F.col("node").alias("w"), F.col("part").alias("label"))
    inner = walk.join(pu, "u").join(pw, ["w", "label"])
    marked, row = measured(inner.where("via <> w").select(F.col("via").alias("v"), "label").distinct(), "marked", n=F.count("*"))
    for table in reversed(rounds if row["n"] else []):  # all pages between via and w: jumps of every length, longest first
        jump = table.where("open").select("v", F.col("a").alias("to"))
        more = marked.join(jump, "v").select(F.col("to").alias("v"), "label")
        marked = materialize(marked.unionByName(more).distinct(), "marked")
    on = parts.select("node", F.col("part").alias("label")).unionByName(marked.select(F.col("v").alias("node"), "label"))
    least = on.groupBy("label").agg(F.min("node").alias("cycle_id"))
    found = on.join(least, "label").select("node", "cycle_id").unionByName(rings.select("node", F.col("label").alias("cycle_id")))
    return found.unionByName(loops.select("node", F.col("label").alias("cycle_id"))).groupBy("node").agg(F.min("cycle_id").alias("cycle_id"))


def running_total(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """df with the sum of `value` over all rows before each row in the given order, over the whole table."""
    spark = df.sparkSession
    ship(spark)
    names = [*df.columns]
    placed = df.repartitionByRange(shuffle_parts(spark), *order).sortWithinPartitions(*order).withColumn("__pid", F.spark_partition_id())

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in it:
            if not b.num_rows:
                continue
            v = b[value].to_numpy(zero_copy_only=False).astype(np.int64)
            run = np.cumsum(v) + total
            yield pa.RecordBatch.from_arrays([*(b[n] for n in names), b["__pid"], pa.array(run - v)], [*names, "__pid", out])
            total = int(run[-1])

    schema = T.StructType([*placed.schema.fields, T.StructField(out, T.LongType())])
    done = materialize(placed.mapInArrow(add, schema), "totals")
    each = sorted((r["__pid"], r["t"]) for r in done.groupBy("__pid").agg(F.max(F.col(out) + F.col(value)).alias("t")).collect())  # one row a partition
    before, sums = 0, []
    for pid, t in each:
        sums.append((pid, before))
        before += t
    carry = F.broadcast(spark.createDataFrame(sums, "__pid int, __before long"))
    return done.join(carry, "__pid").withColumn(out, F.col(out) + F.col("__before")).select(*names, out)


def places(edges: DataFrame, on_cycle: DataFrame) -> DataFrame:
    """(page, ctx, parent, parent_ctx): every place of every page; ctx tells the places of one page apart. Roots have no parent.

    A place's context is made at the last page above it that has several parents, so a tree under one parent has one context.
    """
    spark = edges.sparkSession
    c = on_cycle.select(F.col("node").alias("child"), F.col("cycle_id").alias("cc"))
    p = on_cycle.select(F.col("node").alias("parent"), F.col("cycle_id").alias("cp"))
    kept = edges.join(c, "child", "left").join(p, "parent", "left").where("child <> parent and (cc is null or cp is null or cc <> cp)")
    kept = kept.select("child", "parent")
    counted = materialize(kept.join(kept.groupBy("child").agg(F.count("*").alias("n")), "child"), "kept")
    pages = edges.select(F.explode(F.array("child", "parent")).alias("page")).distinct()
    roots = pages.join(counted.select(F.col("child").alias("page")), "page", "left_anti")
    only = counted.where("n = 1").select(F.col("child").alias("v"), F.col("parent").alias("a"))
    top, _ = _climb(only)
    ends, row = measured(top.select("v", F.col("a").alias("t")), "ends", n=F.count("*"))
    many = counted.where("n > 1").select(F.col("child").alias("m"), F.col("parent").alias("via"))
    walk = many.join(ends.withColumnRenamed("v", "via"), "via", "left").select("m", "via", F.coalesce("t", "via").alias("t"))
    # A context is the way up: a page with several parents, the parent taken, the next such page, ..., the root. Ways are joined end to end:
    # after k rounds those still open have 2^k such pages. What is left of the links has no cycle, so all of them close.
    inner = many.select(F.col("m").alias("t"), F.lit(True).alias("open")).distinct()
    ways = walk.join(inner, "t", "left").select("m", F.array("m", "via").alias("way"), "t", F.coalesce("open", F.lit(False)).alias("open"))
    ways, seen = measured(ways, "ways", n=F.count_if("open"))
    while seen["n"]:
        on = ways.select(F.col("m").alias("t"), F.col("way").alias("way2"), F.col("t").alias("t2"), F.col("open").alias("open2"))
        longer = ways.where("open").join(on, "t").select("m", F.concat("way", "way2").alias("way"), F.col("t2").alias("t"), F.col("open2").alias("open"))
        past = ways
        ways, seen = measured(ways.where("not open").unionByName(longer), "ways", n=F.count_if("open"))
        free(past)
    heads = ways.select(F.col("m").alias("t"), F.concat("way", F.array("t")).alias("way")).unionByName(roots.select(F.col("page").alias("t"), F.array("page").alias("way")))
    heads = materialize(heads.withColumn("ctx", F.monotonically_increasing_id()), "heads")
    above = heads.select(F.col("way").alias("up"), F.col("ctx").alias("parent_ctx"))
    low = heads.where("size(way) > 1").select("t", "ctx", F.element_at("way", 2).alias("parent"), F.expr("slice(way, 3, size(way))").alias("up"))
    none = F.lit(None).cast("long")
    first = heads.where("size(way) = 1").select("t", "ctx", none.alias("parent"), none.alias("parent_ctx"))
    first = first.unionByName(low.join(above, "up").select("t", "ctx", "parent", "parent_ctx"))
    rest = hot_join(ends, heads.select("t", "ctx"), "t", row["n"]).join(only, "v").select(F.col("v").alias("t"), "ctx", F.col("a").alias("parent"), F.col("ctx").alias("parent_ctx"))
    return first.unionByName(rest).withColumnRenamed("t", "page")


def hierarchy(edges: DataFrame, ring: DataFrame | None = None) -> DataFrame:
    """(page_id, parent_id, root_id, depth, path, pre, post, n_descendants, cycle_page_id): one row for every place of every page.

    path: the ids from the root down to the page. pre and post: the nested-set range over all trees. n_descendants: places below.
    ring: cycles(edges), where it is known.
    """
    edges = materialize(edges, "edges")
    ring = materialize(cycles(edges), "cycles") if ring is None else ring
    place = places(edges, ring)
    key = lambda page, ctx: F.struct(F.col(page).alias("p"), F.col(ctx).alias("c"))
    start = place.select(
        key("page", "ctx").alias("id"),
        F.when(F.col("parent").isNotNull(), key("parent", "parent_ctx")).alias("up"),
        F.col("page"),
        F.col("parent"),
    )
    start, row = measured(start, "places", n=F.count("*"))
    n_rows = row["n"]
    # Upward: size after k rounds counts the places less than 2^k levels below; path and depth grow along the same pointers.
    left = {"n": F.count_if(F.col("a").isNotNull())}
    now = start.select("id", F.col("up").alias("a"), F.lit(1).cast("long").alias("size"), F.array("page").alias("path"))
    now, seen = measured(now, "up", **left)
    while seen["n"]:  # pointers span 2^k places and end at roots
        moving = now.where("a is not null")
        below = moving.groupBy("a").agg(F.sum("size").alias("more")).withColumnRenamed("a", "id")
        above = now.select(F.col("id").alias("a"), F.col("a").alias("a2"), F.col("path").alias("path2"))
        grown = hot_join(moving, above, "a", n_rows).select("id", F.col("a2").alias("a"), "size", F.concat("path2", "path").alias("path"))
        grown = grown.unionByName(now.where("a is null")).join(below, "id", "left")
        past = now
        now, seen = measured(grown.select("id", "a", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"), "path"), "up", **left)
        free(past)
    # Downward: a place begins after its parent and its elder siblings.
    flat = start.join(now.select("id", "size", "path"), "id")
    flat = flat.select("id", "up", "page", "parent", "size", "path", F.coalesce("parent", F.lit(-1)).alias("o1"), F.coalesce(F.col("up.c"), F.lit(0)).alias("o2"))
    summed = running_total(flat.select("id", "o1", "o2", "page", "size"), ["o1", "o2", "page"], "size", "before")
    first = summed.groupBy("o1", "o2").agg(F.min("before").alias("first"))
    offset = summed.join(first, ["o1", "o2"]).select("id", (F.col("before") - F.col("first")).alias("elder"))
    down = start.join(offset, "id").select("id", F.col("up").alias("a"), (F.col("elder") + F.when(F.col("up").isNotNull(), 1).otherwise(0)).alias("pre"))
    down, seen = measured(down, "down", **left)
    while seen["n"]:
        above = down.select(F.col("id").alias("a"), F.col("a").alias("a2"), F.col("pre").alias("pre2"))
        moved = hot_join(down.where("a is not null"), above, "a", n_rows).select("id", F.col("a2").alias("a"), (F.col("pre") + F.col("pre2")).alias("pre"))
        past = down
        down, seen = measured(moved.unionByName(down.where("a is null")), "down", **left)
        free(past)
    out = flat.select("id", "page", "parent", "size", "path").join(down.select("id", "pre"), "id")
    out = out.join(ring.select(F.col("node").alias("page"), F.col("cycle_id").alias("cycle_page_id")), "page", "left")
    return out.select(
        F.col("page").alias("page_id"),
        F.col("parent").alias("parent_id"),
        F.element_at("path", 1).alias("root_id"),
        (F.size("path") - 1).alias("depth"),
        "path",
        "pre",
        (F.col("pre") + F.col("size") - 1).alias("post"),
        (F.col("size") - 1).alias("n_descendants"),
        "cycle_page_id",
    )


def descendants(tree: DataFrame, of: DataFrame, block: int = 4096) -> DataFrame:
    """(page_id, descendant_id), distinct: everything below the pages of `of` (page_id), read off the nested-set ranges.

    A range is cut into blocks before it is unfolded, so a root with millions below it isn't one row's work.
    """
    ranges = tree.join(of.select("page_id").distinct(), "page_id", "left_semi").where("post > pre").select("page_id", (F.col("pre") + 1).alias("lo"), F.col("post").alias("hi"))
    blocks = ranges.select("page_id", "hi", F.explode(F.sequence("lo", "hi", F.lit(block).cast("long"))).alias("from"))
    blocks = blocks.repartition("page_id", "from")
    each = blocks.select("page_id", F.explode(F.sequence("from", F.least("hi", F.col("from") + block - 1))).alias("pre"))
    return each.join(tree.select("pre", F.col("page_id").alias("descendant_id")), "pre").select("page_id", "descendant_id").distinct()


def _folded(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The hierarchy of edges with every cycle folded to its smallest page; and (page_id, member), the pages of each cycle."""
    edges = materialize(edges, "edges")
    ring = materialize(cycles(edges), "cycles")
    c = ring.select(F.col("node").alias("child"), F.col("cycle_id").alias("cc"))
    p = ring.select(F.col("node").alias("parent"), F.col("cycle_id").alias("cp"))
    fold = edges.join(c, "child", "left").join(p, "parent", "left")
    # A link within a cycle becomes one of its smallest page to itself, so a cycle without other links keeps its place.
    fold = fold.select(F.coalesce("cc", "child").alias("child"), F.coalesce("cp", "parent").alias("parent")).distinct()
    tree = hierarchy(fold, ring.select(F.col("cycle_id").alias("node"), "cycle_id").distinct())
    return materialize(tree, "tree"), ring.select(F.col("cycle_id").alias("page_id"), F.col("node").alias("member"))


def whole_hierarchy(edges: DataFrame) -> DataFrame:
    """The columns of hierarchy(), with nothing lost at cycles: all pages of a cycle have its places, parents, roots and ranges.

    In parent_id, root_id and path a cycle stands as its smallest page. n_descendants: the pages at the places below, all pages
    of a cycle counted; a page on a cycle is below itself, as are the cycle's others.
    """
    tree, members = _folded(edges)
    size = members.groupBy("page_id").agg(F.count("*").alias("w"))
    sized = tree.join(size, "page_id", "left").select("pre", F.coalesce("w", F.lit(1)).cast("long").alias("w"))
    summed = materialize(running_total(sized, ["pre"], "w", "before"), "sizes")
    upto = summed.select(F.col("pre").alias("post"), (F.col("before") + F.col("w")).alias("upto"))
    out = tree.join(summed.select("pre", "before"), "pre").join(upto, "post").join(members, "page_id", "left")
    itself = F.when(F.col("cycle_page_id").isNull(), 1).otherwise(0)
    return out.withColumn("n_descendants", F.col("upto") - F.col("before") - itself).withColumn("page_id", F.coalesce("member", "page_id")).select(*tree.columns)


def whole_descendants(edges: DataFrame) -> DataFrame:
    """(page_id, descendant_id), distinct: every page that can be reached downward, through cycles too; pages on a cycle reach themselves."""
    tree, members = _folded(edges)
    same = members.select("page_id", F.col("page_id").alias("descendant_id")).distinct()
    pairs = descendants(tree, tree).unionByName(same)
    for end in ("page_id", "descendant_id"):
        m = members.select(F.col("page_id").alias(end), "member")
        pairs = pairs.join(m, end, "left").withColumn(end, F.coalesce("member", end)).drop("member")
    return pairs.select("page_id", "descendant_id")
