"""Joins on keys of which a few may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that a task takes without harm, and the part of all rows from which a key beyond that is hot: HOT_PARTS keys at most.
FEW, HOT_PARTS = 1_000_000, 1000
#: Rows of the other side that are sent to every executor at most.
BROADCAST_ROWS = 200_000


def hot_join(big: DataFrame, small: DataFrame, on: str, n_rows: int, few: int = FEW) -> DataFrame:
    """The inner join of big (n_rows rows) with small. Keys with more than `few` rows and 1 / HOT_PARTS of all of them don't go through the
    exchange: what small has for them (checked against BROADCAST_ROWS) is sent to where big's rows are. The result is that of big.join(small, on).
    """
    if n_rows <= few:
        return big.join(small, on)
    counts = big.groupBy(on).agg(F.count("*").alias("__n")).where(F.col("__n") > max(few, n_rows / HOT_PARTS))
    hot = [r[0] for r in counts.select(on).collect()]  # HOT_PARTS keys at most
    if not hot:
        return big.join(small, on)
    keys = F.broadcast(big.sparkSession.createDataFrame([(k,) for k in hot], big.select(on).schema))
    theirs = small.join(keys, on, "left_semi")
    if theirs.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return big.join(small, on)  # left to adaptive splitting
    rest = big.join(keys, on, "left_anti").join(small, on)
    return big.join(F.broadcast(theirs), on).select(*rest.columns).unionByName(rest)
