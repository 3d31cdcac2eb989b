"""The filters that every retrieval path shares, in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_namespace(column: str, namespace: str | None) -> Column:
    """None: no filter; '': only the global one; otherwise that namespace and the global one."""
    if namespace is None:
        return F.lit(True)
    return F.col(column).isin(namespace, "") if namespace else F.col(column) == ""


def active_on(day: str, valid_from: str = "valid_from", valid_until: str = "valid_until") -> Column:
    """Both ends included; compared as text, as stored; null is open."""
    f, u = F.col(valid_from), F.col(valid_until)
    return (f.isNull() | (f <= day)) & (u.isNull() | (u >= day))


def apply_scope(
    pages: DataFrame,
    wing: str | None = None,
    collection_id: int | None = None,
    namespace: str | None = None,
    include_superseded: bool = False,
    include_quarantined: bool = False,
) -> DataFrame:
    out = pages
    if wing is not None:
        out = out.where(F.col("wing") == wing)
    if collection_id is not None:
        out = out.where(F.col("collection_id") == collection_id)
    out = out.where(in_namespace("namespace_id", namespace)) if namespace is not None else out
    if not include_superseded:
        out = out.where(F.col("superseded_by").isNull())
    if not include_quarantined:
        out = out.where(F.col("quarantined_at").isNull())
    return out


def exact_slug(query: str) -> str | None:
    """The query as a slug, if it can be one: no blanks left once [[ ]] is taken off."""
    q = query.strip()
    if q.startswith("[[") and q.endswith("]]"):
        q = q[2:-2].strip()
    return q if q and not any(c.isspace() for c in q) else None


def prefer_namespace(pages: DataFrame, keys: list[str], namespace: str) -> DataFrame:
    """One page per key: the namespace's own before the global one, then the smallest id."""
    from pyspark.sql import Window

    order = [F.when(F.col("namespace_id") == namespace, 0).otherwise(1), F.col("page_id")]
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return pages.where(in_namespace("namespace_id", namespace)).withColumn("rn", rn).where("rn = 1").drop("rn")


def floor(df: DataFrame, least: float, column: str = "score") -> DataFrame:
    return df if least <= 0 else df.where(F.col(column) >= least)
