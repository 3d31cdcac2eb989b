"""Fusing lexical and vector results: weighted union, reciprocal ranks, per-page limits, floors and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEXICAL_WEIGHT, VECTOR_WEIGHT, RRF_K = 0.4, 0.6, 60


def _share(df: DataFrame, weight: float) -> Column:
    """score as a part of the arm's best one (at least 0), weighted. The arm has at most a few hundred rows."""
    best = F.greatest(F.lit(0.0), F.max("score").over(Window.partitionBy(F.lit(1))))
    return F.when(best > 0, weight * F.col("score") / best).otherwise(0.0)


def union(lexical: DataFrame, vector: DataFrame, key: str = "slug") -> DataFrame:
    """(key, score): 0.4 of the lexical share plus 0.6 of the vector share. Inputs: (key, score), a key once."""
    a = lexical.select(key, _share(lexical, LEXICAL_WEIGHT).alias("a"))
    b = vector.select(key, _share(vector, VECTOR_WEIGHT).alias("b"))
    return a.join(b, key, "full").select(key, (F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0))).alias("score"))


def reciprocal_ranks(arms: list[DataFrame], key: str = "slug", k: int = RRF_K) -> DataFrame:
    """(key, score): the sum over arms of 1 / (k + rank), ranks from 1, scaled so that first in two arms gives 1."""
    out = None
    for arm in arms:
        rn = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("score").desc(), key))
        part = arm.select(key, (F.lit(1.0) / (k + rn)).alias("s"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(key).agg((F.sum("s") * ((k + 1) / 2)).alias("score"))


def limit_per_page(df: DataFrame, most: int, key: str = "slug", tie: str = "chunk_id") -> DataFrame:
    """At most `most` rows per page, best first; the best says in collapsed how many were dropped. 0: no limit."""
    if most <= 0:
        return df.withColumn("collapsed", F.lit(0).cast("long"))
    w = Window.partitionBy(key).orderBy(F.col("score").desc(), tie)
    n = F.count("*").over(Window.partitionBy(key))
    ranked = df.withColumn("rn", F.row_number().over(w)).withColumn("n", n).where(F.col("rn") <= most)
    dropped = F.when(F.col("rn") == 1, F.greatest(F.lit(0), F.col("n") - most)).otherwise(0)
    return ranked.withColumn("collapsed", dropped.cast("long")).drop("rn", "n")


def fill_budget(rows: list[tuple], cost_at: int, budget: int) -> list[tuple]:
    """The rows of a ranked list that fit, in order; a row that doesn't fit is passed over. For lists already cut to a top-k."""
    out, used = [], 0
    for r in rows:
        if used + r[cost_at] <= budget:
            used += r[cost_at]
            out.append(r)
    return out


def trim_to_budget(ranked: DataFrame, budget_chars: int, order: list[Column]) -> DataFrame:
    """slug, summary of a ranked top-k until the characters are used up; the row that crosses the line is cut, later ones go."""
    cost = F.length("slug") + 2 + F.length("summary")
    w = Window.partitionBy(F.lit(1)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = ranked.withColumn("used", F.sum(cost).over(w)).withColumn("left", budget_chars - (F.col("used") - cost) - F.length("slug") - 2)
    return run.where("left > 0").withColumn("summary", F.expr("substring(summary, 1, cast(left as int))")).drop("used", "left")


def mmr(rows: list[tuple[str, float, list[float]]], lam: float, k: int) -> list[str]:
    """Maximal marginal relevance over a top-k list of (key, score, unit vector)."""
    import numpy as np

    left, picked = list(rows), []
    while left and len(picked) < k:
        def value(r):
            near = max((float(np.dot(r[2], p[2])) for p in picked), default=0.0)
            return lam * r[1] - (1 - lam) * near

        best = max(left, key=lambda r: (value(r), r[0]))
        picked.append(best)
        left.remove(best)
    return [r[0] for r in picked]
