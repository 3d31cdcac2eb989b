"""Turn windows, idle sessions, trigger merging and fact resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def turn_windows(turns: DataFrame, cursor: Column, keys: list[str], ordinal: str = "ordinal", k: int = 5) -> DataFrame:
    """keys + (window_no, ordinal, lookback): the turns after the cursor in windows of k; if they are fewer than k, one window filled up
    with the turns before the cursor."""
    t = turns.withColumn("new", F.col(ordinal) > cursor)
    w = Window.partitionBy(*keys)
    t = t.withColumn("n_new", F.count_if("new").over(w)).where("n_new > 0")
    rn = F.row_number().over(Window.partitionBy(*keys, "new").orderBy(F.when(F.col("new"), F.col(ordinal)).otherwise(-F.col(ordinal))))
    t = t.withColumn("rn", rn)
    new = t.where("new").select(*keys, F.floor((F.col("rn") - 1) / k).cast("int").alias("window_no"), ordinal, F.lit(False).alias("lookback"))
    old = t.where(f"not new and n_new < {k} and rn <= {k} - n_new").select(*keys, F.lit(0).alias("window_no"), ordinal, F.lit(True).alias("lookback"))
    return new.unionByName(old)


def idle_sessions(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """key + (session_no, started, ended, n): a silence of `seconds` or more ends a session."""
    w = Window.partitionBy(key).orderBy(ts, "event_id")
    gap = F.timestamp_diff("MICROSECOND", F.lag(ts).over(w), F.col(ts))
    e = events.withColumn("new", F.when(gap.isNull() | (gap >= seconds * 1_000_000), 1).otherwise(0))
    e = e.withColumn("session_no", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy(key, "session_no").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n"))


def ordinals(turns: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """turns with ordinal: 1, 2, ... within a conversation, by time and then by the tie."""
    return turns.withColumn("ordinal", F.row_number().over(Window.partitionBy(key).orderBy(ts, tie)))


def cursors(turns: DataFrame, key: str, ts: str) -> DataFrame:
    """key + (max_ordinal, last_at): where each conversation stands."""
    return turns.groupBy(key).agg(F.count("*").alias("max_ordinal"), F.max(ts).alias("last_at"))


def close_sessions(sessions: DataFrame, now: Column, seconds: int) -> DataFrame:
    """idle_sessions() with closed_at: sessions silent for `seconds` at `now` are closed at their last turn."""
    idle = F.timestamp_diff("MICROSECOND", F.col("ended"), now) >= seconds * 1_000_000
    return sessions.withColumn("closed_at", F.when(idle, F.col("ended")))


def merge_triggers(a: tuple[str, str], b: tuple[str, str]) -> tuple[str, str]:
    """A pending (trigger, time) met by a new one: a close stays as it is, or comes no later; debounces wait for the later time, manual ones for
    the earlier; manual beats debounce with its own time."""
    (x, s), (y, t) = a, b
    if x == "session_close":
        return a
    if y == "session_close":
        return y, min(s, t)
    if x == y:
        return x, max(s, t) if x == "debounce" else min(s, t)
    return ("manual", s) if x == "manual" else ("manual", t)


def merged_jobs(requests: DataFrame, key: str, trigger: str, at: str, order: str) -> DataFrame:
    """key + (trigger, at): the one pending job per key after its requests in order.

    The fold depends on the order only up to the first close: before it, a manual request wins over debounces with the earliest manual time, so
    conditional aggregates give the result without walking the requests.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    closed = F.coalesce(F.max((F.col(trigger) == "session_close").cast("int")).over(w), F.lit(0))
    live = requests.withColumn("__c", closed).where("__c = 0")
    kind = F.col(trigger)
    g = live.groupBy(key).agg(
        F.max(F.when(kind == "session_close", F.col(at))).alias("c"),
        F.min(F.when(kind == "manual", F.col(at))).alias("m"),
        F.max(F.when(kind == "debounce", F.col(at))).alias("d"),
    )
    before = F.coalesce("m", "d")
    return g.select(
        key,
        F.when(F.col("c").isNotNull(), "session_close").when(F.col("m").isNotNull(), "manual").otherwise("debounce").alias("trigger"),
        F.when(F.col("c").isNotNull(), F.least("c", before)).otherwise(before).alias("at"),
    )


def resolve_facts(facts: DataFrame, heads: DataFrame, keys: list[str], cosine: Column, drop_above: float = 0.92, supersede_from: float = 0.4) -> DataFrame:
    """facts + (resolution, head_id): coexist without a head, ambiguous with several, else by the bands of the cosine with the one head."""
    n = heads.groupBy(*keys).agg(F.count("*").alias("n_heads"), F.min("head_id").alias("head_id"), F.min_by("head_embedding", "head_id").alias("head_embedding"))
    met = facts.join(n, keys, "left")
    one = F.when(cosine > drop_above, "drop").when(cosine >= supersede_from, "supersede").otherwise("coexist")
    return met.withColumn("resolution", F.when(F.col("n_heads").isNull(), "coexist").when(F.col("n_heads") > 1, "ambiguous").otherwise(one)).drop("head_embedding")
