"""Near-duplicate texts: ProbMinHash signatures, banding, and exact verification.

Signatures. Each weighted shingle is a Poisson process of arrivals with its weight as rate; each arrival falls on a random
register of the text's signature, which keeps the earliest. A shingle's arrivals are followed only until they are later than
every register of the text (early termination), so a text of n shingles costs about n + m log m steps instead of n times m. Two
registers are equal with the probability Jaccard similarity of the weighted sets, which for equal weights is the Jaccard
similarity itself.

Candidates. Registers are banded; texts that agree in a whole band meet in one bucket. Buckets of one text are dropped before
anything else is attached. Within a bucket, a pair goes on only if 4-bit sketches of all registers agree as often as they would
at the threshold, less a margin of two and a half standard deviations; so a bucket of texts that share boilerplate yields
comparisons but hardly a row. A large bucket is cut into groups, and every two groups are compared in a task of their own. Candidates are then verified on the texts themselves.

Exact copies are folded first (map side), whatever their number: one of each class is signed and compared. near_duplicates() gives the
links between representatives and the membership of every page, which is linear in the pages; all_pairs() writes them out as pairs of
pages, copies within a class included, at any size of a class. The rows are then as many as the pairs, so a class of n copies has
n (n - 1) / 2 of them; they are made in cells of CELL by CELL pages, and no task gets more than a cell.

Defined results
* null, empty and short texts (fewer than `least_words` words) have no pairs and are groups of their own.
* similarity must be greater than the threshold; ties don't matter; an empty table gives an empty result.
* repeated rows of one id count once (any of the texts that came with it first in order); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.skew import hot_join
from ..session import materialize, measured, ship
from . import words as wd

REGISTERS, BAND, SHINGLE, LEAST_WORDS = 256, 4, 3, 20
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: list[str | None], n: int = SHINGLE, least_words: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash, occurrences) of the distinct n-word shingles of every text of at least least_words words."""
    w = wd.words(texts)
    if len(w.doc) < n:
        z = np.zeros(0, np.int64)
        return z, z.astype(np.uint64), z
    h, doc = wd.ngram_hash(w.hash, n), w.doc[: len(w.doc) - n + 1]
    ok = (doc == w.doc[n - 1 :]) & (np.bincount(w.doc, minlength=w.n_docs)[doc] >= least_words)
    h, doc = h[ok], doc[ok]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def prob_min_hash(doc: np.ndarray, h: np.ndarray, weight: np.ndarray | None, n_docs: int, m: int = REGISTERS) -> np.ndarray:
    """n_docs x m registers (float32: the earliest arrival; infinite for texts without shingles). m: a power of two."""
    reg = np.full(n_docs * m, np.inf, np.float32)
    live, t, step = np.arange(len(h)), np.zeros(len(h)), np.uint64(0)
    with np.errstate(over="ignore"):
        while len(live):
            step += _GOLD
            x = wd.mix(h[live] + step)
            gap = -np.log1p(-((x >> np.uint64(11)).astype(np.float64) * 2.0**-53))
            t = t + (gap if weight is None else gap / weight[live])
            d = doc[live]
            np.minimum.at(reg, d * m + (x & np.uint64(m - 1)).astype(np.int64), t.astype(np.float32))
            late = reg.reshape(n_docs, m).max(axis=1)
            on = t <= late[d]
            live, t = live[on], t[on]
    return reg.reshape(n_docs, m)


def band_keys(reg: np.ndarray, rows: int = BAND) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of the key."""
    bits = reg.view(np.uint32).astype(np.uint64).reshape(len(reg), -1, rows)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(wd.mix(np.arange(1, bits.shape[1] + 1, dtype=np.uint64) * _GOLD), bits.shape[:2])
        for k in range(rows):
            key = wd.mix(key * _GOLD + bits[:, :, k])
    return key.view(np.int64)


def sketches(reg: np.ndarray) -> np.ndarray:
    """Four bits of every register, sixteen registers to a 64-bit number."""
    nib = (wd.mix(reg.view(np.uint32).astype(np.uint64)) >> np.uint64(60)).reshape(len(reg), -1, 16)
    return np.bitwise_or.reduce(nib << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=2).view(np.int64)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _sign(weighted: bool, n: int, least: int, m: int, rows: int):
    def sign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = b["text"].to_pylist()
            for part in wd.chunks([len(t or "") for t in texts]):
                doc, h, count = shingles(texts[part], n, least)
                size = part.stop - part.start
                has = np.flatnonzero(np.bincount(doc, minlength=size))
                if not len(has):
                    continue
                local = np.searchsorted(has, doc)
                reg = prob_min_hash(local, h, count.astype(np.float64) if weighted else None, len(has), m)
                ids = b["id"].slice(part.start, size).take(pa.array(has))
                yield pa.RecordBatch.from_arrays([ids, _lists(band_keys(reg, rows)), _lists(sketches(reg))], ["id", "keys", "sketch"])

    return sign


#: Rows of a bucket up to which its pairs are one task's work; a larger one is cut into groups, and each two groups meet in a cell.
CELL = 2000


def _equal_nibbles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many of the registers' 4-bit sketches agree, row by row."""
    d = x ^ y
    d |= d >> np.uint64(2)
    d |= d >> np.uint64(1)
    return 16 * x.shape[1] - np.bitwise_count(d & np.uint64(0x1111111111111111)).sum(axis=1, dtype=np.int64)


def _compare(least: int, longs: int):
    """Rows sorted by (key, c1, c2), grouped in cells -> distinct pairs of ids whose sketches agree in `least` registers or more."""

    def pairs(key: np.ndarray, side: np.ndarray, ids: np.ndarray, sk: np.ndarray) -> np.ndarray:
        n = len(ids)
        end = np.searchsorted(key, key, side="right") if n else key
        out, d, i = [], 1, np.arange(n)
        while len(i := i[end[i] > i + d]):
            for a in range(0, len(i), 65536):
                x = i[a : a + 65536]
                y = x + d
                ok = side[x] != side[y]
                x, y = x[ok], y[ok]
                ok = _equal_nibbles(sk[x], sk[y]) >= least
                if ok.any():
                    p, q = ids[x[ok]], ids[y[ok]]
                    out.append(np.stack([np.minimum(p, q), np.maximum(p, q)], axis=1))
            d += 1
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for b in it:
            if not b.num_rows:
                continue
            cols = [b[n].to_numpy(zero_copy_only=False) for n in ("key", "c1", "c2", "grp", "id")]
            sk = b["sketch"].flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, longs)
            held.append((*cols, sk))
            key, c1, c2, grp, ids, sk = (np.concatenate(x) for x in zip(*held))
            cell = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]) | (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])]).astype(np.int64))
            cut = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on in the next batch
            # Within a cell of one group every two rows meet; in a cell of two groups only rows of different groups.
            side = np.where(c1 == c2, np.arange(len(ids)), grp)
            got = pairs(cell[:cut], side[:cut], ids[:cut], sk[:cut])
            held = [tuple(x[cut:] for x in (key, c1, c2, grp, ids, sk))]
            if len(got):
                yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], ["a", "b"])
        if held and len(held[0][0]):
            key, c1, c2, grp, ids, sk = held[0]
            got = pairs(np.zeros(len(ids), np.int64), np.where(c1 == c2, np.arange(len(ids)), grp), ids, sk)
            if len(got):
                yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], ["a", "b"])

    return run


def similarity(left: list[str | None], right: list[str | None], n: int = SHINGLE, least_words: int = LEAST_WORDS) -> np.ndarray:
    """Jaccard similarity of the distinct shingles of left[i] and right[i]; 0 where either has none."""
    (da, ha, _), (db, hb, _) = shingles(left, n, least_words), shingles(right, n, least_words)
    k = len(left)
    d, h = np.concatenate([da, db]), np.concatenate([ha, hb])
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    both = np.bincount(d[1:][(d[1:] == d[:-1]) & (h[1:] == h[:-1])], minlength=k) if len(d) > 1 else np.zeros(k, np.int64)
    total = np.bincount(d, minlength=k) - both
    return both / np.maximum(total, 1)


def _verify(threshold: float, n: int, least: int):
    def verify(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            left, right = b["text_a"].to_pylist(), b["text_b"].to_pylist()
            for part in wd.chunks([len(x) + len(y) for x, y in zip(left, right)]):
                s = similarity(left[part], right[part], n, least)
                keep = np.flatnonzero(s > threshold)
                if len(keep):
                    take = pa.array(keep + part.start)
                    yield pa.RecordBatch.from_arrays([b["a"].take(take), b["b"].take(take), pa.array(s[keep])], ["a", "b", "similarity"])

    return verify


def classes(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """texts (id, text) -> (members: id, rep, class_size), (reps: id, text). Copies have the same text to the byte."""
    parts = [F.xxhash64("text"), F.xxhash64(F.lit(1), "text"), F.length("text")]
    keyed = texts.select("id", "text", F.struct(*(p.alias(f"h{i}") for i, p in enumerate(parts))).alias("key"))
    small = keyed.select("id", "key")
    size, row = measured(small.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("class_size")), "classes", n=F.sum("class_size"))
    members = hot_join(small, size, "key", row["n"] or 0).select("id", "rep", "class_size")  # a class may hold a third of all pages
    reps = keyed.groupBy("key").agg(F.min(F.struct("id", "text")).alias("r")).select("r.id", "r.text")
    return members, reps


def near_duplicates(
    texts: DataFrame,
    threshold: float = 0.5,
    n: int = SHINGLE,
    least_words: int = LEAST_WORDS,
    weighted: bool = False,
    m: int = REGISTERS,
    rows: int = BAND,
) -> tuple[DataFrame, DataFrame]:
    """texts (id, text), one row an id -> (links: a, b, similarity between representatives; members: id, rep, class_size).

    weighted: shingles weigh as often as they occur in the search for candidates; verification is on distinct shingles.
    """
    ship(texts.sparkSession)
    # Shorter texts can't have least_words words: that many letters and the blanks between them.
    texts = texts.where(F.length("text") >= 2 * least_words - 1)
    members, reps = classes(texts)
    signed = materialize(reps.mapInArrow(_sign(weighted, n, least_words, m, rows), "id long, keys array<long>, sketch array<long>"), "signatures")
    buckets = signed.select("id", F.explode("keys").alias("key"))
    # One exchange by key: the bucket's size comes from a window over it.
    buckets = buckets.withColumn("n", F.expr("count(*) over (partition by key)")).where("n > 1")
    groups_ = F.ceil(F.col("n") / CELL).cast("int")
    buckets = buckets.withColumn("g", groups_).withColumn("grp", F.when(F.col("g") > 1, F.pmod(F.xxhash64("id"), "g").cast("int")).otherwise(0))
    cells = buckets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    cells = cells.select("id", "key", "grp", F.least("grp", "other").alias("c1"), F.greatest("grp", "other").alias("c2"))
    met = cells.join(signed.select("id", "sketch"), "id").repartition("key", "c1", "c2").sortWithinPartitions("key", "c1", "c2")
    least = threshold + (1 - threshold) / 16 - 2.5 * (0.25 / m) ** 0.5
    found = met.select("key", "c1", "c2", "grp", "id", "sketch").mapInArrow(_compare(int(least * m), m // 16), "a long, b long").distinct()
    by_id = texts.select("id", "text")
    pairs = found.join(by_id.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(
        by_id.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b"
    )
    links = pairs.select("a", "b", "text_a", "text_b").mapInArrow(_verify(threshold, n, least_words), "a long, b long, similarity double")
    return links, members


def all_pairs(links: DataFrame, members: DataFrame, texts: DataFrame, least_words: int = LEAST_WORDS, cell: int = CELL) -> DataFrame:
    """(a, b), a < b: the links between all pages of the linked classes, and all pairs of copies within each class."""
    parts = F.ceil(F.col("class_size") / cell).cast("int")
    many = members.where("class_size > 1").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    held = many.select("rep", "part", F.col("id").alias("__id"))
    sizes = many.where("id = rep").select("rep", "parts")

    def spread(df: DataFrame, end: str) -> DataFrame:
        """One row for each page of the class that `end` represents: a row is sent to each part of the class."""
        cut = df.join(sizes.withColumnRenamed("rep", end), end, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        met = cut.join(held.withColumnRenamed("rep", end), [end, "part"], "left").where("parts is null or __id is not null")
        return met.withColumn(end, F.coalesce("__id", end)).drop("__id", "part", "parts")

    between = spread(spread(links.select("a", "b"), "a"), "b")
    # Whether a class's text is long enough is decided on its representative's text.
    long_enough = texts.join(many.where("id = rep").select("id"), "id", "left_semi").mapInArrow(_enough(least_words), "rep long")
    kept = many.join(long_enough, "rep", "left_semi")
    x = kept.select("rep", "id", F.col("part").alias("c1"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("c2"))
    y = kept.select("rep", F.col("id").alias("other"), F.col("part").alias("c2"), F.explode(F.sequence(F.lit(0), "part")).alias("c1"))
    within = x.join(y, ["rep", "c1", "c2"]).where("c1 < c2 or id < other").select(F.col("id").alias("a"), F.col("other").alias("b"))
    return between.unionByName(within).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _enough(least: int):
    def enough(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            w = wd.words(b["text"].to_pylist())
            ok = np.flatnonzero(np.bincount(w.doc, minlength=w.n_docs) >= least)
            yield pa.RecordBatch.from_arrays([b["id"].take(pa.array(ok))], ["rep"])

    return enough


def groups(ids: DataFrame, links: DataFrame, members: DataFrame) -> DataFrame:
    """(id, class_id, group_id, n_links): one row an id. n_links counts the links of the id's class to other classes."""
    links = materialize(links, "links")
    part = connected_components(links, "a", "b")
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    classed = ids.select("id").distinct().join(members, "id", "left").select("id", F.coalesce("rep", "id").alias("class_id"))
    info = part.join(degree, "node", "left")
    return classed.join(info, F.col("class_id") == F.col("node"), "left").select(
        "id", "class_id", F.coalesce("component", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
