"""Evaluation texts that leaked into documents: latent semantic retrieval, then common-subsequence and answer checks.

Passages (windows of WINDOW words) of all documents and items are weighted by TF-IDF over the words of the items, with counts over all
passages of the corpus. A randomised SVD of that matrix is computed across the cluster: each task multiplies its own passages
with a thin matrix and back, tasks' products are added up by blocks of terms, and the driver only ever holds terms x RANK numbers. A
document's passages and the items' are compared by cosine in the latent space; a pair at COSINE or more is a candidate. Candidates
are checked on the words themselves: the longest common subsequence made of stretches of STRETCH words or more, in the order of
both texts. Passages without STRETCH words of the items in a row cannot hold such a stretch and aren't compared.

Items are the stated query set and are held by the driver with the basis of their words. Documents are encoded in the words of all items
once, and the latent space is made once; the items are then searched for in blocks of ITEM_BLOCK, so that what a task holds of them is
bounded. Counts and the search take windows every STEP words; the product for the basis takes those that don't overlap.

Words are runs of letters and digits in lower case; markup, zero-width characters and escaped line breaks are taken out first. A word
of a document that an item writes with punctuation inside (a possessive, a date) counts as the item's words, so that dropped
punctuation doesn't hide a copy.

Defined results
* an opening sentence that STOCK_ITEMS items or more share is no part of an item; an item without other words is never found.
* null and empty texts hold nothing; an empty table on either side gives an empty result; repeated rows give the same pairs once.
* ties don't matter: every pair at a threshold is in. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship
from . import words as wd

WINDOW, STEP, STRETCH, COVER = 16, 8, 6, 0.4
ITEM_STEP = 4
RANK, EXTRA, COSINE = 64, 16, 0.75
STOCK_ITEMS, ITEM_BLOCK = 3, 5000
PARAPHRASE = 0.9
_BLOCKS, FAN, _PARTS = 64, 64, "task int, block int, part binary"
#: Numbers in one product of passages with the items' windows.
_PRODUCT = 1 << 23

_DROP = re.compile("[​-‍⁠﻿­]|(?<=\\w)-[ \t]*\r?\n[ \t>]*(?=[a-z])")
_MARKUP = re.compile(r"<[A-Za-z/!][^<>\n]{0,300}>|\]\([^)\s]*\)|\\[nrt](?![a-z]*:)")
_JOINED = re.compile(r"[^\W_]+(?:['’.,:/‐-―-][^\W_]+)+")


def clean(text: str | None) -> str:
    if not text:
        return ""
    if "&" in text:
        text = html.unescape(text)
    return _MARKUP.sub(" ", _DROP.sub("", text))


def stock_openings(items: DataFrame, text_col: str = "item_text") -> DataFrame:
    """(opening): the first sentences, in lower case, that STOCK_ITEMS items or more share."""
    first = F.lower(F.regexp_extract(F.trim(text_col), r"^([^.!?]*[.!?]+)\s", 1))
    return items.select(first.alias("opening")).where("opening <> ''").groupBy("opening").agg(F.count("*").alias("n")).where(f"n >= {STOCK_ITEMS}").select("opening")


@dataclass
class ItemIndex:
    """A block of items as arrays. Terms are numbered from 1; 0 is every other word."""

    ids: np.ndarray
    sizes: np.ndarray  # words per item
    terms: np.ndarray  # sorted hashes of the words
    joined: np.ndarray  # sorted hashes of words written with punctuation inside, without it
    parts: list[np.ndarray]  # the term numbers each of them stands for
    grams: np.ndarray  # sorted hashes of STRETCH consecutive terms
    gram_item: np.ndarray
    gram_at: np.ndarray
    windows: list[np.ndarray]
    window_item: np.ndarray
    answers: list[np.ndarray]


def gram_hash(ids: np.ndarray) -> np.ndarray:
    return wd.ngram_hash(wd.mix(ids.astype(np.uint64) + np.uint64(1)), STRETCH)


def _numbers(terms: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
    return np.where(terms[at] == h, at + 1, 0).astype(np.int32)


def _hashes(text: str) -> np.ndarray:
    return wd.words([text]).hash


def index_items(rows: list[tuple[int, str, str | None]], whole: ItemIndex | None = None) -> ItemIndex | None:
    """rows: (item_id, text without stock sentence, answer). whole: the index of all items, if rows are a block of them: its terms are used."""
    rows = [(i, clean(t), clean(a)) for i, t, a in rows]
    rows = [r for r in rows if len(_hashes(r[1]))]
    if not rows:
        return None
    said = [_hashes(t) for _, t, _ in rows]
    answered = [_hashes(a) for _, _, a in rows]
    terms = whole.terms if whole else np.unique(np.concatenate(said + answered))
    seqs = [_numbers(terms, h) for h in said]
    joined = {}
    for _, t, _ in rows:
        for m in _JOINED.findall(t):
            h = _hashes(re.sub(r"[\W_]+", "", m))
            if len(h) == 1 and not _numbers(terms, h)[0]:
                joined.setdefault(int(h[0]), _numbers(terms, _hashes(m)))
    order = sorted(joined)
    grams, gi, ga, win, wi = [], [], [], [], []
    for k, s in enumerate(seqs):
        g = gram_hash(s)
        grams.append(g)
        gi.append(np.full(len(g), k))
        ga.append(np.arange(len(g)))
        for a in range(0, max(1, len(s) - WINDOW + ITEM_STEP), ITEM_STEP):
            win.append(s[a : a + WINDOW])
            wi.append(k)
    g = np.concatenate(grams)
    o = np.argsort(g, kind="stable")
    return ItemIndex(
        np.array([r[0] for r in rows]), np.array([len(s) for s in seqs]), terms, np.array(order, np.uint64), [joined[h] for h in order],
        g[o], np.concatenate(gi)[o], np.concatenate(ga)[o], win, np.array(wi), [_numbers(terms, h) for h in answered],
    )


def encode(texts: list[str | None], ix: ItemIndex) -> tuple[np.ndarray, np.ndarray]:
    """(term numbers of all words of all texts, bounds of the texts)."""
    w = wd.words([clean(t) for t in texts])
    ids = _numbers(ix.terms, w.hash)
    if len(ix.joined) and len(ids):
        at = np.minimum(np.searchsorted(ix.joined, w.hash), len(ix.joined) - 1)
        hit = (ids == 0) & (ix.joined[at] == w.hash)
        if hit.any():
            size = np.ones(len(ids), np.int64)
            where = np.flatnonzero(hit)
            size[where] = [len(ix.parts[k]) for k in at[where]]
            first = np.cumsum(size) - size
            out, doc = np.repeat(ids, size), np.repeat(w.doc, size)
            for p, k in zip(where, at[where]):
                out[first[p] : first[p] + size[p]] = ix.parts[k]
            return out, np.searchsorted(doc, np.arange(w.n_docs + 1))
    return ids, w.bounds()


def _windows(ids: np.ndarray, bounds: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(document number, first word) of the passages of every text; the last one may be short."""
    size = np.diff(bounds)
    n = np.where(size > 0, np.maximum(1, -(-(size - WINDOW + step) // step)), 0)
    doc = np.repeat(np.arange(len(size)), n)
    return doc, bounds[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * step


def _cells(ids: np.ndarray, bounds: np.ndarray, doc: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, term, occurrences), by passage, of the terms in each passage."""
    at = first[:, None] + np.arange(WINDOW)
    t = np.where(at < bounds[doc + 1][:, None], ids[np.minimum(at, max(len(ids) - 1, 0))], 0) if len(ids) else np.zeros(at.shape, np.int32)
    key = np.sort((np.arange(len(first))[:, None].astype(np.int64) << 32 | t).ravel())
    key = key[(key & 0xFFFFFFFF) > 0]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[new] >> 32, (key[new] & 0xFFFFFFFF) - 1, np.diff(np.append(new, len(key)))


def _weights(p: np.ndarray, t: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights of cells, each passage of length one."""
    v = ((1 + np.log(n)) * idf[t]).astype(np.float32)
    norm = np.sqrt(np.bincount(p, v * v)) if len(p) else np.zeros(0)
    return (v / np.maximum(norm[p], 1e-9)).astype(np.float32)


def _project(p: np.ndarray, t: np.ndarray, v: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the passages that have cells, their rows of A M)."""
    if not len(p):
        return np.zeros(0, np.int64), np.zeros((0, m.shape[1]), np.float32)
    start = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    return p[start], np.add.reduceat(m[t] * v[:, None], start, axis=0)


def _gram_product(p: np.ndarray, t: np.ndarray, v: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A^T A M for the passages given."""
    out = np.zeros(m.shape, np.float64)
    if not len(p):
        return out
    which, rows = _project(p, t, v, m)
    order = np.argsort(t, kind="stable")
    ts = t[order]
    start = np.flatnonzero(np.concatenate([[True], ts[1:] != ts[:-1]]))
    back = np.searchsorted(which, p[order])
    out[ts[start]] = np.add.reduceat(rows[back] * v[order][:, None], start, axis=0)
    return out


def _batches(it: Iterator[pa.RecordBatch], most: int = 400_000) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids of the documents, their terms, bounds), in parts of about `most` words."""
    for b in it:
        if not b.num_rows:
            continue
        col = b["terms"]
        off = col.offsets.to_numpy()
        flat = col.values.to_numpy(zero_copy_only=False)
        a = 0
        while a < b.num_rows:
            z = max(a + 1, int(np.searchsorted(off, off[a] + most)))
            z = min(z, b.num_rows)
            yield b["doc_id"].slice(a, z - a), flat[off[a] : off[z]], off[a : z + 1] - off[a]
            a = z


def _encode_documents(ix: ItemIndex):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = b["text"].to_pylist()
            for part in wd.chunks([len(t or "") for t in texts]):
                ids, bounds = encode(texts[part], ix)
                yield pa.RecordBatch.from_arrays(
                    [b["doc_id"].slice(part.start, part.stop - part.start), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))], ["doc_id", "terms"]
                )

    return run


def _count_terms(n_terms: int):
    """Rows (term, passages with it); term -1 counts all passages."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = np.zeros(n_terms, np.int64), 0
        for _, ids, bounds in _batches(it):
            doc, first = _windows(ids, bounds, STEP)
            _, t, _ = _cells(ids, bounds, doc, first)
            seen += np.bincount(t, minlength=n_terms)
            total += len(first)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], total))], ["term", "n"])

    return run


def _multiply(m: np.ndarray, idf: np.ndarray):
    """Rows (task, block of terms, its part of A^T A M as bytes) of a task's passages, here those that don't overlap: each word counts once."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(m.shape, np.float64)
        for _, ids, bounds in _batches(it):
            doc, first = _windows(ids, bounds, WINDOW)
            p, t, n = _cells(ids, bounds, doc, first)
            out += _gram_product(p, t, _weights(p, t, n, idf), m)
        parts = np.array_split(out.astype(np.float32), _BLOCKS)
        task = pa.array([TaskContext.get().partitionId()] * _BLOCKS, pa.int32())
        yield pa.RecordBatch.from_arrays([task, pa.array(range(_BLOCKS), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], ["task", "block", "part"])

    return run


def _add(parts: pa.Table) -> pa.Table:
    """The sum of up to FAN parts of one block of terms."""
    total = 0.0
    for x in parts["part"]:
        total = total + np.frombuffer(x.as_buffer(), np.float32).astype(np.float64)
    return pa.table({"task": parts["task"].slice(0, 1), "block": parts["block"].slice(0, 1), "part": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def _tree_sum(parts: DataFrame, n: int) -> DataFrame:
    """The sums of the parts of n tasks, by block, in a tree of FAN branches: no task adds more than FAN parts."""
    while n > 1:
        parts = parts.withColumn("task", F.floor(F.col("task") / FAN).cast("int")).groupBy("block", "task").applyInArrow(_add, _PARTS)
        n = -(-n // FAN)
    return parts


def _item_cells(ix: ItemIndex) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(w) for w in ix.windows])
    ids = np.concatenate(ix.windows)
    bounds = np.concatenate([[0], np.cumsum(size)])
    return _cells(ids, bounds, np.arange(len(size)), bounds[:-1])


def latent_space(encoded: DataFrame, ix: ItemIndex, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(idf per term, terms x RANK basis) of the passages of all documents and items, by randomised subspace iteration."""
    n_terms = len(ix.terms)
    counted = encoded.mapInArrow(_count_terms(n_terms), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r["term"]: r["n"] for r in counted.collect()}  # as many rows as the block of items has words
    df = np.zeros(n_terms)
    for t, n in found.items():
        if t >= 0:
            df[t] = n
    idf = np.log((found.get(-1, 0) + 1) / (df + 1)) + 1
    p, t, n = _item_cells(ix)
    v = _weights(p, t, n, idf)
    width = min(RANK + EXTRA, n_terms)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((n_terms, width)))[0]
    for _ in range(2):
        q = q.astype(np.float32)
        parts = _tree_sum(encoded.mapInArrow(_multiply(q, idf), _PARTS), encoded.rdd.getNumPartitions()).collect()  # _BLOCKS rows
        y = _gram_product(p, t, v, q)
        if parts:
            y += np.concatenate([np.frombuffer(r["part"], np.float32) for r in sorted(parts, key=lambda r: r["block"])]).reshape(n_terms, width)
        small = q.T @ y
        basis = q
        q = np.linalg.qr(y)[0]
    _, u = np.linalg.eigh((small + small.T) / 2)  # Rayleigh-Ritz on the last subspace
    return idf, np.ascontiguousarray((basis @ u[:, ::-1][:, :RANK]).astype(np.float32))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def chain(i: np.ndarray, j: np.ndarray, size: np.ndarray) -> int:
    """Words in the longest common subsequence made of the given equal stretches (i, j: where they begin; size: their words)."""
    order = np.lexsort((j, i))
    best: list[int] = []
    runs = [(int(i[k]), int(j[k]), int(size[k])) for k in order]
    for k, (a, b, n) in enumerate(runs):
        most = n
        for m in range(k):
            c, d, o = runs[m]
            if c <= a and d <= b and (c, d) != (a, b):
                left = n - max(0, c + o - a, d + o - b)
                if left >= STRETCH:
                    most = max(most, best[m] + left)
        best.append(most)
    return max(best, default=0)


def _stretches(ids: np.ndarray, bounds: np.ndarray, ix: ItemIndex, doc: np.ndarray, item: np.ndarray) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The maximal equal stretches of each (document, item) pair given."""
    out: dict = {}
    docs = np.unique(doc)
    wanted = np.sort(doc.astype(np.int64) * len(ix.ids) + item)
    for d in docs:
        s = ids[bounds[d] : bounds[d + 1]]
        g = gram_hash(s)
        lo, hi = np.searchsorted(ix.grams, g), np.searchsorted(ix.grams, g, side="right")
        n = hi - lo
        if not n.sum():
            continue
        i = np.repeat(np.arange(len(g)), n)
        e = np.repeat(lo, n) + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        k, j = ix.gram_item[e], ix.gram_at[e]
        key = d.astype(np.int64) * len(ix.ids) + k
        at = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
        ok = wanted[at] == key
        i, j, k = i[ok], j[ok], k[ok]
        order = np.lexsort((i, i - j, k))
        i, j, k = i[order], j[order], k[order]
        if not len(i):
            continue
        new = np.concatenate([[True], (k[1:] != k[:-1]) | ((i - j)[1:] != (i - j)[:-1]) | (i[1:] != i[:-1] + 1)])
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(i))) + STRETCH - 1
        for item_no in np.unique(k[at]):
            mine = k[at] == item_no
            out[int(d), int(item_no)] = (i[at][mine], j[at][mine], size[mine])
    return out


def _has(s: np.ndarray, sub: np.ndarray) -> bool:
    if not len(sub) or len(s) < len(sub):
        return False
    ok = np.ones(len(s) - len(sub) + 1, bool)
    for k, x in enumerate(sub):
        ok &= s[k : k + len(ok)] == x
    return bool(ok.any())


def _search(ix: ItemIndex, idf: np.ndarray, basis: np.ndarray, cosine: float):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, t, n = _item_cells(ix)
        items = np.zeros((len(ix.windows), basis.shape[1]), np.float32)
        which, rows = _project(p, t, _weights(p, t, n, idf), basis)
        items[which] = _unit(rows)
        items = np.ascontiguousarray(items.T)
        edge = np.flatnonzero(np.concatenate([[True], ix.window_item[1:] != ix.window_item[:-1]]))
        for doc_ids, ids, bounds in _batches(it, 100_000):
            doc, first = _windows(ids, bounds, STEP)
            if not len(first):
                continue
            # Only passages with STRETCH of the items' words in a row can hold a stretch.
            known = np.concatenate([[0], np.cumsum(ids > 0)])
            full = np.zeros(len(ids) + 1, np.int64)
            if len(ids) >= STRETCH:
                full[: len(ids) - STRETCH + 1] = known[STRETCH:] - known[: len(ids) - STRETCH + 1] == STRETCH
            starts = np.concatenate([[0], np.cumsum(full)])
            last = np.minimum(first + WINDOW, bounds[doc + 1]) - STRETCH + 1
            ok = (last > first) & (starts[np.maximum(last, first)] > starts[first])
            doc, first = doc[ok], first[ok]
            best: dict[int, np.ndarray] = {}
            step = max(16, min(2048, _PRODUCT // max(1, items.shape[1])))
            for a in range(0, len(first), step):
                d = doc[a : a + step]
                p, t, n = _cells(ids, bounds, d, first[a : a + step])
                which, rows = _project(p, t, _weights(p, t, n, idf), basis)
                near = np.maximum.reduceat(_unit(rows) @ items, edge, axis=1)
                r, c = np.nonzero(near >= cosine)
                for x, k, s in zip(d[which[r]], c, near[r, c]):
                    got = best.setdefault(int(x), np.zeros(len(ix.ids), np.float32))
                    got[k] = max(got[k], s)
            if not best:
                continue
            pair_doc = np.concatenate([np.full((v > 0).sum(), k) for k, v in best.items()])
            pair_item = np.concatenate([np.flatnonzero(v) for v in best.values()])
            runs = _stretches(ids, bounds, ix, pair_doc, pair_item)
            out = []
            for x, k in zip(pair_doc, pair_item):
                found = runs.get((int(x), int(k)))
                words = chain(*found) if found is not None else 0
                close = float(best[int(x)][k])
                if not words and close < PARAPHRASE:
                    continue
                answer = _has(ids[bounds[x] : bounds[x + 1]], ix.answers[k])
                if not words and not answer:
                    continue
                out.append((int(x), int(ix.ids[k]), words / int(ix.sizes[k]), close, answer))
            if out:
                x, k, cover, close, answer = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.take(pa.array(x)), pa.array(k, pa.int64()), pa.array(cover, pa.float64()), pa.array(close, pa.float64()), pa.array(answer)],
                    ["doc_id", "item_id", "coverage", "cosine", "answer_found"],
                )

    return run


_SCHEMA = "doc_id long, item_id long, coverage double, cosine double, answer_found boolean"


def find_leaks(documents: DataFrame, items: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(doc_id, item_id, coverage, cosine, answer_found) of every candidate pair with a common stretch, or close and with the answer.

    documents: doc_id, text. items: item_id, item_text, answer.
    """
    spark = documents.sparkSession
    ship(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    stock = {r["opening"] for r in stock_openings(items).collect()}  # distinct openings shared by several items of the stated set
    out = spark.createDataFrame([], _SCHEMA)
    held = []
    for r in items.select("item_id", "item_text", "answer").where("item_text is not null").distinct().toLocalIterator():
        text = r["item_text"].strip()
        m = re.match(r"[^.!?]*[.!?]+(?=\s)", text)
        held.append((r["item_id"], text[m.end() :] if m and m.group().lower() in stock else text, r["answer"]))
    whole = index_items(held)
    if whole is None:
        return out
    encoded = materialize(docs.mapInArrow(_encode_documents(whole), "doc_id long, terms array<int>"), "terms")
    idf, basis = latent_space(encoded, whole)
    for block in batched(held, ITEM_BLOCK):
        if ix := index_items(list(block), whole):
            out = out.unionByName(encoded.mapInArrow(_search(ix, idf, basis, cosine), _SCHEMA))
    return out


def leaks(pairs: DataFrame, cover: float = COVER) -> DataFrame:
    """The pairs of find_leaks() in which the document holds at least `cover` of the item's words."""
    return pairs.where(f"coverage >= {cover}")
