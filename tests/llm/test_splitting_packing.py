import random

import numpy as np
import pytest

from sedimenta.llm import packing, splitting


def _text(rng, n):
    out = []
    while sum(map(len, out)) < n:
        out.append(rng.choice(["word ", "A sentence ends. ", "\n", "\n\n", "# Head\n", "- entry one\n", "---\n", "\r\n", "ü", "漢字。", "é", "👩‍👧", "x" * 300, "\t"]))
    return "".join(out)


@pytest.mark.parametrize("seed", range(12))
def test_cuts_round_trip(seed):
    rng = random.Random(seed)
    texts = [_text(rng, rng.randint(2500, 30000)).encode() for _ in range(6)] + [b"y" * 9000, "é".encode() * 5000, b"\n" * 4000]
    doc, lo, hi = splitting.cuts(texts)
    for d, t in enumerate(texts):
        a, z = lo[doc == d], hi[doc == d]
        assert a[0] == 0 and z[-1] == len(t)
        assert (z - a <= splitting.LIMIT).all() and (z[1:] > z[:-1]).all()
        rep = z[:-1] - a[1:]
        assert (rep >= splitting.OVERLAP).all() and (rep <= splitting.OVERLAP + splitting.SLACK + 40).all()
        pieces = [(t[x:y], r) for x, y, r in zip(a, z, [0, *rep])]
        assert splitting.join_pieces(pieces) == t
        for p, _ in pieces:
            p.decode()


def test_cuts_follow_successors():
    """The doubled tables give what a loop over the pieces gives."""
    rng = random.Random(5)
    t = _text(rng, 40000).encode()
    doc, lo, hi = splitting.cuts([t])
    both = splitting.cuts([t, t])
    assert (both[1][both[0] == 1] == lo).all() and (both[2][both[0] == 0] == hi).all()


def test_natural_cuts():
    t = ("# One\n" + "Some words here. " * 90 + "\n\n# Two\n" + "Other words there. " * 90).encode()
    _, lo, hi = splitting.cuts([t])
    assert t[hi[0] :].startswith(b"# Two")


def test_split_operator(spark):
    rows = [(1, "a", None), (2, "b", ""), (3, "c", "x" * 1920), (4, "d", "x" * 1921), (4, "d", "x" * 1921), (5, None, "ü" * 3000)]
    df = spark.createDataFrame(rows, "page_id long, piece_no string, piece string")
    out = splitting.split_oversized(df.withColumnRenamed("piece_no", "k"), ["page_id"], "piece").collect()
    assert sorted({r.page_id for r in out}) == [4, 5]
    assert sum(r.page_id == 4 and r.piece_no == 0 for r in out) == 2
    small = splitting.split_oversized(df.withColumnRenamed("piece_no", "k"), ["page_id"], "piece", keep_small=True).collect()
    assert {r.page_id for r in small} == {2, 3, 4, 5}
    assert splitting.split_oversized(df.limit(0).withColumnRenamed("piece_no", "k"), ["page_id"], "piece").count() == 0


def _bfd(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        fit = [i for i, left in enumerate(bins) if left >= s]
        if fit:
            i = min(fit, key=lambda i: bins[i])
            bins[i] -= s
        else:
            bins.append(capacity - s)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(20))
def test_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(5, 200))
    sizes = rng.integers(1, capacity + 1, int(rng.integers(1, 400))).tolist()
    counts = {s: sizes.count(s) for s in set(sizes)}
    left = {}
    for r in packing.best_fit_decreasing(counts, capacity):
        for k in range(r.rank_until - r.rank_from):
            left[r.container + k] = left.get(r.container + k, capacity) - r.size
    assert sorted(left.values()) == _bfd(sizes, capacity)


def test_pack_operator(spark):
    texts = [None, "", "hello world", "hello world", "word " * 5000, *[f"some text number {i} " * (i % 50 + 1) for i in range(200)]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("rank", __import__("pyspark.sql.functions", fromlist=["x"]).lit("clash")).repartition(3)
    out = packing.pack(df).collect()
    enc = packing.encoding()
    total = {i: len(enc.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    got, fill = {}, {}
    for r in out:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_tokens
        if r.container_id is not None:
            fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
    assert got == total and max(fill.values()) <= packing.CAPACITY
    assert sorted(fill) == list(range(len(fill)))
    assert {r.doc_id for r in out if r.container_id is None} == {0, 1}
    assert len(fill) == -(-sum(total.values()) // packing.CAPACITY)
    assert packing.pack(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_long_texts_in_segments_are_cut_alike(seed):
    rng = random.Random(seed)
    for t in (_text(rng, 120_000).encode(), ("é" * 40_000).encode(), b"z" * 50_000):
        _, lo, hi = splitting.cuts([t])
        a, z = splitting.long_cuts(t, segment=20_000)
        assert (a == lo).all() and (z == hi).all()
