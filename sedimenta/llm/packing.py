"""Filling containers of fixed capacity with texts: best-fit decreasing over all texts at once.

Best-fit decreasing depends on the sizes alone, and a size is one of at most `capacity` whole numbers. So the sizes are counted
over all texts (capacity numbers at most reach the driver), the packing is found for the counts, and each text takes its place
by its rank among the texts of its size. The result is that of best-fit decreasing run on every text in one list, without a
list anywhere. A segment tree over the remaining capacities finds the tightest open container in logarithmic time; all
containers with the same remaining capacity are alike and are filled together.

Defined results
* a text of more than `capacity` tokens is cut into full containers and a rest, in its order; no other text is split.
* a null or empty text has no tokens and gets no container (container_id null, one row).
* repeated rows are items of their own; ties take their places in order of the partition and the row; an empty table gives an empty result.
* other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, ship

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The splitting pattern of the byte-level vocabulary (fixed value, published with it).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Runs of placements up to which they are sent to every executor; beyond it they are joined like any table.
BROADCAST_RUNS = 200_000

_ENCODINGS: dict[str, object] = {}


def encoding(path: str = TOKENIZER):
    """The public tokenizer in a rank file, loaded once a worker."""
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


class SegmentTree:
    """Which remaining capacities have open containers; leaf c is set while some container has c left."""

    def __init__(self, capacity: int) -> None:
        self.base = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.base)

    def put(self, leaf: int, there: bool) -> None:
        i = leaf + self.base
        self.any[i] = there
        while i > 1:
            i >>= 1
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]

    def tightest(self, least: int) -> int:
        """The smallest set leaf that is at least `least`, or -1."""
        i = least + self.base
        if self.any[i]:
            return least
        while i > 1:  # up to the first right sibling that holds something, then down its left edge
            if not i & 1 and self.any[i + 1]:
                i += 1
                while i < self.base:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.base
            i >>= 1
        return -1


@dataclass(frozen=True)
class Run:
    """Items of one size, by rank [rank_from, rank_until), one each into the containers from `container` on."""

    size: int
    rank_from: int
    rank_until: int
    container: int


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[Run]:
    """The packing of counts[s] items of each size s (1..capacity). The work depends on the number of sizes, not of items."""
    tree, open_, runs, used = SegmentTree(capacity), {}, [], 0  # open_: remaining -> ranges of container ids

    def add(left: int, lo: int, hi: int) -> None:
        if left and hi > lo:
            if not open_.get(left):
                tree.put(left, True)
            open_.setdefault(left, []).append((lo, hi))

    for size in sorted((s for s, n in counts.items() if n > 0), reverse=True):
        rank, n = 0, counts[size]
        while rank < n:
            left = tree.tightest(size)
            if left < 0:
                left = capacity
                lo, used = used, used + -(-(n - rank) // (capacity // size))
                hi = used
            else:
                lo, hi = open_[left].pop()
                if not open_[left]:
                    tree.put(left, False)
            # The tightest container stays the tightest while the size still fits: it takes `each` items before the next one does.
            each = left // size
            rows = min(hi - lo, (n - rank) // each)
            if not rows:
                rows, each = 1, n - rank
            for _ in range(each):
                runs.append(Run(size, rank, rank + rows, lo))
                rank += rows
            add(left - each * size, lo, lo + rows)
            if lo + rows < hi:
                add(left, lo + rows, hi)
    return runs


def measure(documents: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(pid, doc_id, piece_no, token_from, n_tokens, rank): the items, with their rank among those of their size in the partition."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(tokenizer)
        seen = np.zeros(capacity + 1, np.int64)
        for b in it:
            if not b.num_rows:
                continue
            total = np.fromiter((len(enc.encode_ordinary(t)) if t else 0 for t in (x.as_py() for x in b["text"])), np.int64, b.num_rows)
            pieces = np.maximum(1, -(-total // capacity))
            row = np.repeat(np.arange(b.num_rows), pieces)
            no = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            size = np.minimum(capacity, total[row] - no * capacity)
            order = np.argsort(size, kind="stable")
            ordered = size[order]
            first = np.searchsorted(ordered, ordered)
            rank = np.empty(len(row), np.int64)
            rank[order] = np.arange(len(row)) - first + seen[ordered]
            seen += np.bincount(size, minlength=capacity + 1)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [b["pid"].take(take), b["doc_id"].take(take), pa.array(no, pa.int32()), pa.array(no * capacity, pa.int64()), pa.array(size, pa.int32()), pa.array(rank, pa.int64())],
                ["pid", "doc_id", "piece_no", "token_from", "n_tokens", "rank"],
            )

    rows = documents.select(F.spark_partition_id().alias("pid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, "pid int, doc_id long, piece_no int, token_from long, n_tokens int, rank long")


def pack(documents: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece_no, token_from, n_tokens, container_id): every text, or piece of an oversized text, in its container."""
    spark = documents.sparkSession
    ship(spark)
    items = materialize(measure(documents, tokenizer, capacity, id_col, text_col), "items")
    # At most one row a partition and size; the offsets turn ranks within partitions into ranks over all texts.
    per = materialize(items.where("n_tokens > 0").groupBy("n_tokens", "pid").agg(F.count("*").alias("n")), "sizes")
    before = Window.partitionBy("n_tokens").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    counts = {r["n_tokens"]: r["n"] for r in per.groupBy("n_tokens").agg(F.sum("n").alias("n")).collect()}  # `capacity` rows at most
    runs = best_fit_decreasing(counts, capacity)
    placed = spark.createDataFrame([(r.size, r.rank_from, r.rank_until, r.container) for r in runs], "n_tokens int, rank_from long, rank_until long, container long")
    if len(runs) <= BROADCAST_RUNS:
        placed = F.broadcast(placed)
    place = F.col("rank") + F.col("shift")
    full = items.where("n_tokens > 0").join(offsets, ["n_tokens", "pid"]).withColumn("place", place).drop("rank", "shift")
    full = full.join(placed, (full["n_tokens"] == placed["n_tokens"]) & (full["place"] >= placed["rank_from"]) & (full["place"] < placed["rank_until"])).select(
        "doc_id", "piece_no", "token_from", full["n_tokens"], (F.col("container") + F.col("place") - F.col("rank_from")).alias("container_id")
    )
    none = items.where("n_tokens = 0").select("doc_id", "piece_no", "token_from", "n_tokens", F.lit(None).cast("long").alias("container_id"))
    return full.unionByName(none)
