"""Continuous periods and gaps of day intervals, per entity.

The method is a distributed scan. Intervals are range-sorted by (entity, first day), so that an entity with a third of all
rows spreads over many partitions. Each partition is folded once into a summary of fixed size (its first and last entity, the
last entity's furthest day and where its last island begins); the summaries, one a partition, are combined by prefix; then each
partition is scanned again with the state carried into it, which gives every interval its island.

Defined results
* null or blank ends are open; a day may be written YYYY-MM-DD, YYYY/MM/DD or YYYYMMDD, with or without a time of day, which
  doesn't matter. A text that is no day at all makes the row void: it covers nothing and comes out of void_intervals().
* an interval that ends before it begins covers nothing.
* intervals that touch (one ends the day before the next begins) are continuous.
* repeated rows and ties change nothing; an empty table gives an empty result; a null part of the entity counts as ''.
* other columns of the input are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, shuffle_parts, ship

#: Days since 1970 that stand for "open"; far outside the calendar, so that +1 and -1 never reach a real day.
OPEN_FROM, OPEN_UNTIL = -10_000_000, 10_000_000
_DAY = r"^\s*([0-9]{4})[-/]?([0-9]{2})[-/]?([0-9]{2})(?:$|[^0-9].*$)"


def day_number(text: Column) -> Column:
    """Days since 1970-01-01 of a day in any accepted spelling; null where the text is no day."""
    iso = F.concat_ws("-", F.regexp_extract(text, _DAY, 1), F.regexp_extract(text, _DAY, 2), F.regexp_extract(text, _DAY, 3))
    return F.unix_date(F.try_to_date(iso, "yyyy-MM-dd"))


def _blank(text: Column) -> Column:
    return text.isNull() | (F.trim(F.regexp_replace(text, r"\s", " ")) == "")


def _days(df: DataFrame, valid_from: str, valid_until: str) -> tuple[Column, Column]:
    f, u = F.col(valid_from), F.col(valid_until)
    return (
        F.when(_blank(f), F.lit(OPEN_FROM)).otherwise(day_number(f)),
        F.when(_blank(u), F.lit(OPEN_UNTIL)).otherwise(day_number(u)),
    )


def intervals(df: DataFrame, entity: Column, valid_from: str = "valid_from", valid_until: str = "valid_until") -> DataFrame:
    """(entity string, lo int, hi int): one row per distinct interval start of an entity, with the furthest end.

    Rows with the same start are merged before the sort, on the map side first, so repeats never pile up in one task.
    """
    lo, hi = _days(df, valid_from, valid_until)
    return (
        df.select(F.coalesce(entity, F.lit("")).alias("entity"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
        .where("lo is not null and hi is not null and lo <= hi")
        .groupBy("entity", "lo")
        .agg(F.max("hi").alias("hi"))
    )


def void_intervals(df: DataFrame, valid_from: str = "valid_from", valid_until: str = "valid_until") -> DataFrame:
    """The rows with an end that is neither blank nor a day, or that end before they begin."""
    lo, hi = _days(df, valid_from, valid_until)
    return df.where(lo.isNull() | hi.isNull() | (lo > hi))


def _runs(entity: pa.Array) -> np.ndarray:
    """0, 0, 1, ...: the number of entity changes before each row."""
    n = len(entity)
    step = np.zeros(n, np.int64)
    if n > 1:
        step[1:] = pc.not_equal(entity.slice(1), entity.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return np.cumsum(step)


_BIG = 1 << 32


def _scan(run: np.ndarray, lo: np.ndarray, hi: np.ndarray, carry: tuple[int, int] | None) -> tuple[np.ndarray, np.ndarray]:
    """Furthest day before each row within its entity (or OPEN_FROM - 1 - _BIG for none), and the start of each row's island.

    carry: (furthest day, island start) of the first run's entity from earlier partitions.
    """
    n = len(lo)
    shift = run * _BIG  # entities don't mix: a later run beats every value of an earlier one
    reach = np.maximum.accumulate(hi + shift)
    before = np.empty(n, np.int64)
    before[0], before[1:] = -_BIG, reach[:-1]
    if carry is not None:
        first = run == 0
        before[first] = np.maximum(before[first], carry[0])
    first_of_run = np.empty(n, bool)
    first_of_run[0], first_of_run[1:] = True, run[1:] != run[:-1]
    before -= shift
    none = first_of_run.copy()
    if carry is not None:
        none[0] = False
    before[none] = -_BIG
    new = lo > before + 1
    at = np.maximum.accumulate(np.where(new, np.arange(n), -1))
    start = np.where(at >= 0, lo[np.maximum(at, 0)], carry[1] if carry is not None else 0)
    return before, start


def _local_scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scan one sorted partition as if nothing came before it. head: whether a row is of the partition's first entity."""
    last, state, head = None, None, True
    for b in it:
        if not b.num_rows:
            continue
        e, lo, hi = b["entity"], b["lo"].to_numpy().astype(np.int64), b["hi"].to_numpy().astype(np.int64)
        run = _runs(e)
        same = last is not None and e[0].as_py() == last
        head = head and (same or last is None)
        before, start = _scan(run, lo, hi, state if same else None)
        far = int(hi[run == run[-1]].max())
        if run[-1] == 0 and same:
            far = max(far, state[0])
        last, state = e[len(e) - 1].as_py(), (far, int(start[-1]))
        yield pa.RecordBatch.from_arrays(
            [b["pid"], e, b["lo"], b["hi"], pa.array(before, pa.int64(), mask=before < OPEN_FROM - 1), pa.array(start, pa.int64()), pa.array((run == 0) & head)],
            ["pid", "entity", "lo", "hi", "before", "island", "head"],
        )
        head = head and run[-1] == 0


def _prefix(rows: list[dict]) -> list[tuple[int, int, int]]:
    """(pid, furthest day, island) carried into each partition that begins within an entity begun before. rows: by partition."""
    carried, entity, state = [], None, None
    for r in rows:
        inside = entity is not None and r["first"] == entity
        if inside:
            carried.append((r["pid"], *state))
        if inside and r["first"] == r["last"]:  # the last local island joins the carried one where it begins within reach
            state = (max(state[0], r["far"]), state[1] if r["island"] <= state[0] + 1 else r["island"])
        else:
            state = (r["far"], r["island"])
        entity = r["last"]
    return carried


def label_islands(spans: DataFrame, partitions: int | None = None) -> DataFrame:
    """(entity, lo, hi, before, island): each interval with the furthest covered day before it (null where the entity begins)
    and the first day of its continuous period. spans: the result of intervals()."""
    spark = spans.sparkSession
    ship(spark)
    n = partitions or shuffle_parts(spark)
    placed = spans.repartitionByRange(n, "entity", "lo").sortWithinPartitions("entity", "lo").withColumn("pid", F.spark_partition_id())
    scanned = materialize(
        placed.mapInArrow(_local_scan, "pid int, entity string, lo int, hi int, before long, island long, head boolean"), "intervals"
    )
    sums = scanned.groupBy("pid").agg(
        F.min("entity").alias("first"),
        F.max("entity").alias("last"),
        F.max(F.struct("entity", "hi"))["hi"].cast("long").alias("far"),
        F.max(F.struct("entity", "lo", "island"))["island"].alias("island"),
    )
    # One row a partition, n at most, whatever the size of the data.
    carried = _prefix(sorted((r.asDict() for r in sums.collect()), key=lambda r: r["pid"]))
    schema = "pid int, carried_far long, carried_island long"
    state = F.broadcast(spark.createDataFrame(carried, schema))
    far, reached = F.col("carried_far"), F.col("head") & F.col("carried_far").isNotNull()
    return scanned.join(state, "pid", "left").select(
        "entity",
        "lo",
        "hi",
        F.when(reached, F.greatest(F.col("before"), far)).otherwise(F.col("before")).alias("before"),
        F.when(reached & (F.col("island") <= far + 1), F.col("carried_island")).otherwise(F.col("island")).alias("island"),
    )


def _day(days: Column) -> Column:
    return F.date_format(F.date_from_unix_date(days.cast("int")), "yyyy-MM-dd")


def periods(spans: DataFrame, partitions: int | None = None) -> DataFrame:
    """(entity, period_from, period_until): the continuous periods, as days; null where a period is open."""
    out = label_islands(spans, partitions).groupBy("entity", "island").agg(F.max("hi").alias("hi"))
    return out.select(
        "entity",
        F.when(F.col("island") > OPEN_FROM, _day(F.col("island"))).alias("period_from"),
        F.when(F.col("hi") < OPEN_UNTIL, _day(F.col("hi"))).alias("period_until"),
    )


def gaps(spans: DataFrame, partitions: int | None = None) -> DataFrame:
    """(entity, gap_from, gap_until): the maximal runs of uncovered days between two covered days, as days."""
    out = label_islands(spans, partitions).where("before is not null and lo > before + 1")
    return out.select("entity", _day(F.col("before") + 1).alias("gap_from"), _day(F.col("lo") - 1).alias("gap_until"))
