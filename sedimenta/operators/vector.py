"""Vector retrieval: cosine scores by block products in Arrow batches, top-k, best chunk per page, and the offline embedder."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

QUERY_BLOCK = 4096


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 where lengths differ, are 0, or a norm is 0. An expression for single pairs of columns."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


def _matrix(col: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of unit vectors, which rows they are): rows of another length, or null, are left out."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    size = np.diff(col.offsets.to_numpy())
    ok = np.flatnonzero((size == width) & col.is_valid().to_numpy(zero_copy_only=False))
    rows = col.take(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    norm = np.linalg.norm(rows, axis=1)
    return rows / np.where(norm > 0, norm, 1)[:, None], ok


def score_against(rows: DataFrame, query: list[float], vector_col: str = "embedding", out: str = "score") -> DataFrame:
    """rows with the cosine to one query vector; 0 for vectors of another length."""
    ship(rows.sparkSession)
    q = np.asarray(query, np.float64)
    q = q / (np.linalg.norm(q) or 1)

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in it:
            s = np.zeros(len(a))
            m, ok = _matrix(a, len(q))
            s[ok] = m @ q
            yield pa.array(s)

    run.__annotations__ = {"it": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return rows.withColumn(out, F.arrow_udf(run, "double")(F.col(vector_col)))


def knn(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank): the k nearest rows of each query by cosine, ties by id; exact.

    The stated queries go to the executors in blocks of QUERY_BLOCK; each batch of rows is multiplied with a block and keeps its k best
    per query, so what is shuffled is k rows a batch and query.
    """
    ship(rows.sparkSession)
    out = None
    for block in batched(queries.select(id_col, vector_col).where(F.col(vector_col).isNotNull()).toLocalIterator(), QUERY_BLOCK):
        ids = np.array([r[0] for r in block])
        q = np.array([r[1] for r in block], np.float64)
        norm = np.linalg.norm(q, axis=1)
        q = q / np.where(norm > 0, norm, 1)[:, None]

        def run(it: Iterator[pa.RecordBatch], q=q, ids=ids) -> Iterator[pa.RecordBatch]:
            for b in it:
                m, ok = _matrix(b["v"], q.shape[1])
                if not len(ok):
                    continue
                mine = b["id"].to_numpy()[ok]
                s = np.round(q @ m.T, 12)
                if s.shape[1] > k:
                    kth = -np.partition(-s, k - 1, axis=1)[:, k - 1]
                    r, c = np.nonzero(s >= kth[:, None])  # ties at the k-th place all stay
                else:
                    r, c = np.indices(s.shape).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(mine[c]), pa.array(s[r, c])], ["query_id", "id", "score"])

        part = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).mapInArrow(run, "query_id long, id long, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return rows.sparkSession.createDataFrame([], "query_id long, id long, score double, rank int")
    rn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return out.withColumn("rank", rn).where(F.col("rank") <= k)


def best_by_label(rows: DataFrame, queries: DataFrame, label_col: str = "label", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, label, score): the best cosine of each query to the rows of each label, over all rows but the query itself; exact.

    A batch of rows is multiplied with a block of queries and keeps one score per query and label, so what is shuffled is a row a batch,
    query and label.
    """
    ship(rows.sparkSession)
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("label", rows.schema[label_col].dataType), T.StructField("score", T.DoubleType())])
    out = rows.sparkSession.createDataFrame([], schema)
    for block in batched(queries.select(id_col, vector_col).where(F.col(vector_col).isNotNull()).toLocalIterator(), QUERY_BLOCK):
        ids = np.array([r[0] for r in block])
        q = np.array([r[1] for r in block], np.float64)
        norm = np.linalg.norm(q, axis=1)
        q = q / np.where(norm > 0, norm, 1)[:, None]

        def run(it: Iterator[pa.RecordBatch], q=q, ids=ids) -> Iterator[pa.RecordBatch]:
            for b in it:
                m, ok = _matrix(b["v"], q.shape[1])
                if not len(ok):
                    continue
                coded = b["label"].take(pa.array(ok)).dictionary_encode("encode")
                code = coded.indices.to_numpy(zero_copy_only=False)
                order = np.argsort(code, kind="stable")
                starts = np.flatnonzero(np.diff(code[order], prepend=-1))
                s = np.round(q @ m[order].T, 12)
                s[ids[:, None] == b["id"].to_numpy()[ok][order]] = -np.inf
                best = np.maximum.reduceat(s, starts, axis=1)
                r, c = np.nonzero(best > -np.inf)
                label = coded.dictionary.take(pa.array(code[order][starts][c]))
                yield pa.RecordBatch.from_arrays([pa.array(ids[r]), label, pa.array(best[r, c])], ["query_id", "label", "score"])

        part = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")).mapInArrow(run, schema)
        out = out.unionByName(part)
    return out.groupBy("query_id", "label").agg(F.max("score").alias("score"))


def evidence(model: Column, stand_in: str = "stand-in") -> tuple[Column, Column]:
    """(kind, may_supersede): what vectors of the stand-in are worth; only a model's may supersede a fact."""
    kind = F.when(model.isNull() | (model == stand_in), "stand-in").otherwise("model")
    return kind, F.when(kind == "stand-in", "refused").otherwise("allowed")


def best_chunk(scored: DataFrame, page_col: str, score_col: str = "score") -> DataFrame:
    return scored.groupBy(page_col).agg(F.max(score_col).alias(score_col))


def shim_embedding(text: str, width: int = 384) -> np.ndarray:
    """A deterministic stand-in for an embedding model: hashed words with their places, of length one."""
    out = np.zeros(width)
    for i, word in enumerate(text.split()):
        at = 0
        for chunk in range(-(-width // 32)):
            h = hashlib.sha256(word.encode() + i.to_bytes(8, "little") + chunk.to_bytes(8, "little")).digest()
            part = np.frombuffer(h, np.uint8)[: width - at] / 127.5 - 1
            out[at : at + len(part)] += part
            at += len(part)
    norm = np.linalg.norm(out)
    return (out / norm if norm else out).astype(np.float32)


def embed(texts: DataFrame, text_col: str, width: int = 384, out: str = "embedding", model=None) -> DataFrame:
    """texts with an embedding column. model: a function from a list of texts to rows of floats, loaded once a task; the stand-in by default.

    Null and blank texts have no embedding.
    """
    ship(texts.sparkSession)
    embed_all = model or (lambda many: [shim_embedding(t, width) for t in many])

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in it:
            held = [(i, t.strip()) for i, t in enumerate(a.to_pylist()) if t and t.strip()]
            rows: list = [None] * len(a)
            for (i, _), v in zip(held, embed_all([t for _, t in held])):
                rows[i] = np.asarray(v, np.float32)
            yield pa.array(rows, pa.list_(pa.float32()))

    run.__annotations__ = {"it": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return texts.withColumn(out, F.arrow_udf(run, "array<float>")(F.col(text_col)))
