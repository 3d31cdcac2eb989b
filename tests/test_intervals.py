import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from sedimenta.operators import intervals as iv

D0 = date(2020, 1, 1)


def brute(rows):
    """Gaps and periods of (entity, from, until) by marking days; open ends reach past the calendar of the test."""
    days = {}
    for e, a, z in rows:
        lo = -50 if a is None else (a - D0).days
        hi = 450 if z is None else (z - D0).days
        days.setdefault(e, set()).update(range(lo, hi + 1))
    gaps, periods = set(), set()
    for e, s in days.items():
        if not s:
            continue
        at = sorted(s)
        start = at[0]
        for x, y in zip(at, at[1:] + [None]):
            if y is None or y > x + 1:
                periods.add((e, None if start == -50 else str(D0 + timedelta(start)), None if x == 450 else str(D0 + timedelta(x))))
                if y is not None:
                    gaps.add((e, str(D0 + timedelta(x + 1)), str(D0 + timedelta(y - 1))))
                    start = y
    return gaps, periods


@pytest.mark.parametrize("seed", range(4))
def test_against_days(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(300):
        a = rng.randint(0, 380)
        z = a + rng.choice([0, 0, 1, 3, 20])
        # One entity has a third of all rows.
        e = "hot" if rng.random() < 0.34 else f"e{rng.randint(0, 12)}"
        rows.append((e, None if rng.random() < 0.02 else D0 + timedelta(a), None if rng.random() < 0.02 else D0 + timedelta(z)))
    text = lambda d: rng.choice([str(d), str(d).replace("-", "/"), str(d).replace("-", ""), f" {d} ", f"{d}T23:00:00Z", f"{d} 00:00:00"]) if d else rng.choice([None, "", "  "])
    df = spark.createDataFrame([(e, text(a), text(z)) for e, a, z in rows], "e string, valid_from string, valid_until string")
    spans = iv.intervals(df.unionByName(df), F.col("e"))
    gaps, periods = brute(rows)
    assert {tuple(r) for r in iv.gaps(spans, 7).collect()} == gaps
    assert {tuple(r) for r in iv.periods(spans, 7).collect()} == periods


def test_one_entity_over_many_partitions(spark):
    rows = [(str(D0 + timedelta(2 * i)), str(D0 + timedelta(2 * i + (i % 10 != 9)))) for i in range(200)]
    df = spark.createDataFrame(rows, "valid_from string, valid_until string")
    spans = iv.intervals(df, F.lit("one"))
    assert iv.gaps(spans, 9).count() == 19
    assert iv.periods(spans, 9).count() == 20
    long = spark.createDataFrame([("2019-01-01", "2030-01-01")], "valid_from string, valid_until string")
    assert iv.gaps(iv.intervals(df.unionByName(long), F.lit("one")), 9).count() == 0


def test_defined_results(spark):
    rows = [("a", "2020-01-05", "2020-01-01"), ("b", "someday", "2020-01-01"), ("c", None, None), (None, "2020-01-01", "2020-01-01"), ("d", "2020-02-30", "2020-03-01")]
    df = spark.createDataFrame(rows, "e string, valid_from string, valid_until string").withColumn("lo", F.lit("clash")).withColumn("pid", F.lit(1)).withColumn("entity", F.lit("x"))
    spans = iv.intervals(df, F.col("e"))
    assert {tuple(r) for r in iv.periods(spans).collect()} == {("c", None, None), ("", "2020-01-01", "2020-01-01")}
    assert {r.e for r in iv.void_intervals(df).collect()} == {"a", "b", "d"}
    assert iv.gaps(iv.intervals(df.limit(0), F.col("e"))).count() == 0
    assert iv.periods(iv.intervals(df.limit(0), F.col("e"))).count() == 0
