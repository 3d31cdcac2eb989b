import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedimenta.llm import neardup as nd
from sedimenta.llm import words as wd


def sets(t):
    import re

    w = re.findall(r"[^\W_]+", t.lower())
    return frozenset(zip(w, w[1:], w[2:])) if len(w) >= 20 else frozenset()


def corpus(seed=0, n=120):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(4000)]
    out = {}
    for i in range(n):
        out[i] = " ".join(rng.choices(vocab, k=rng.randint(20, 120)))
    for i in range(n, 2 * n):  # edited copies, from slight to heavy
        w = out[rng.randrange(n)].split()
        for _ in range(rng.randint(0, len(w) // 6)):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], [rng.choice(vocab)], [w[k], rng.choice(vocab)]])
        out[i] = ("# " if i % 2 else "") + ", ".join(w).upper() if i % 3 else " ".join(w)
    return out


def pairs(texts):
    s = {i: sets(t) for i, t in texts.items() if t}
    ids = sorted(s)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if s[a] and 2 * len(s[a] & s[b]) > len(s[a] | s[b])}


def test_words():
    w = wd.words(["Ab c_d 12x", None, "", "ÄÖ ab 漢字"])
    assert w.doc.tolist() == [0, 0, 0, 0, 3, 3, 3]
    assert w.start.tolist() == [0, 3, 5, 7, 0, 3, 6] and w.end.tolist() == [2, 4, 6, 10, 2, 5, 8]
    assert w.hash[0] == w.hash[5]
    assert len(set(wd.words([" ".join(f"t{i}" for i in range(5000))]).hash.tolist())) == 5000


def test_register_agreement_is_similarity():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 400).astype(np.uint64)
    a, b = h[:300], h[100:]
    doc = np.repeat([0, 1], [300, 300 if len(b) == 300 else len(b)])
    reg = nd.prob_min_hash(doc, np.concatenate([a, b]), None, 2, 4096)
    assert abs((reg[0] == reg[1]).mean() - 0.5) < 0.04
    w = np.concatenate([np.r_[np.full(100, 3.0), np.ones(200)], np.ones(300)])  # weights count
    reg = nd.prob_min_hash(doc, np.concatenate([a, b]), w, 2, 4096)
    assert 0.2 < (reg[0] == reg[1]).mean() < 0.45


def test_found_pairs(spark):
    texts = corpus()
    want = pairs(texts)
    rows = [*texts.items(), (900, None), (901, ""), (902, "too short"), (903, "x " * 50_000), *((1000 + i, texts[0]) for i in range(3))]
    want |= pairs({**{0: texts[0]}, **{1000 + i: texts[0] for i in range(3)}}) | {(a, 1000 + i) for a, b in want if b == 0 for i in range(3)} | {(b, 1000 + i) for a, b in want if a == 0 for i in range(3)}
    df = spark.createDataFrame(rows, "id long, text string").withColumn("key", F.lit("clash")).withColumn("a", F.lit(1))
    links, members = nd.near_duplicates(df)
    got = {tuple(sorted(r)) for r in nd.all_pairs(links, members, df).collect()}
    assert len(want - got) <= 0.01 * len(want) and not got - want
    g = {r.id: r for r in nd.groups(df, links, members).collect()}
    assert len(g) == len(rows) and g[1000].class_id == g[1002].class_id and g[900].group_id == 900
    for a, b in got:
        assert g[a].group_id == g[b].group_id


def test_large_classes_come_as_all_pairs(spark):
    text = " ".join(f"u{i}" for i in range(40))
    df = spark.createDataFrame([(i, text) for i in range(60)], "id long, text string")
    links, members = nd.near_duplicates(df)
    for cell in (7, 1000):  # in many cells or in one: all pairs
        assert sorted(tuple(r) for r in nd.all_pairs(links, members, df, cell=cell).collect()) == [(i, j) for i in range(60) for j in range(i + 1, 60)]


def test_large_buckets_are_cut(spark, monkeypatch):
    texts = corpus(3, 60)
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    whole = {tuple(r) for r in nd.near_duplicates(df)[0].select("a", "b").collect()}
    monkeypatch.setattr(nd, "CELL", 2)
    assert {tuple(r) for r in nd.near_duplicates(df)[0].select("a", "b").collect()} == whole


def test_empty(spark):
    df = spark.createDataFrame([], "id long, text string")
    links, members = nd.near_duplicates(df)
    assert nd.all_pairs(links, members, df).count() == 0 and nd.groups(df, links, members).count() == 0


def test_links_of_large_classes(spark):
    """A page that is near a class of more copies than a cell holds is paired with all of them."""
    text = " ".join(f"word{i}" for i in range(40))
    df = spark.createDataFrame([*((i, text) for i in range(4)), (9, text + " more")], "id long, text string")
    members = spark.createDataFrame([*((i, 0, 4) for i in range(4)), (9, 9, 1)], "id long, rep long, class_size long")
    links = spark.createDataFrame([(0, 9, 0.9)], "a long, b long, similarity double")
    got = sorted(tuple(r) for r in nd.all_pairs(links, members, df, cell=2).collect())
    assert got == [(0, 1), (0, 2), (0, 3), (0, 9), (1, 2), (1, 3), (1, 9), (2, 3), (2, 9), (3, 9)]
