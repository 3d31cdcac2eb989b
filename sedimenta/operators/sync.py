"""File diffs, rename inference, upserts with version checks, latest-wins tables and pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

LEAST_BYTES = 64


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rn", rn).where("__rn = 1").drop("__rn")


def file_diff(stored: DataFrame, walked: DataFrame, stats: list[str], key: str = "rel_path") -> DataFrame:
    """(key, change): new, missing, modified (any stat differs, nulls compared as values) or unchanged."""
    a = stored.select(key, F.struct(*stats).alias("a"))
    b = walked.select(key, F.struct(*stats).alias("b"))
    same = F.col("a").eqNullSafe(F.col("b"))
    change = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "missing").when(same, "unchanged").otherwise("modified")
    return a.join(b, key, "full").select(key, change.alias("change"))


def unique_matches(missing: DataFrame, new: DataFrame, by: str, key: str = "rel_path") -> DataFrame:
    """(from_path, to_path): values of `by` that one missing and one new file have, and no other."""
    n = F.count("*").over(Window.partitionBy(by))
    one = lambda df, out: df.where(F.col(by).isNotNull()).withColumn("n", n).where("n = 1").select(by, F.col(key).alias(out))
    return one(missing, "from_path").join(one(new, "to_path"), by).select("from_path", "to_path")


def infer_renames(missing: DataFrame, new: DataFrame, native: DataFrame | None = None, key: str = "rel_path") -> DataFrame:
    """(from_path, to_path, how): watcher pairs first, then ids, then content of LEAST_BYTES or more; each file once.

    missing, new: key, uuid, sha256, size.
    """
    out = None
    missing, new = materialize(missing, "missing"), materialize(new, "new")  # read by every stage
    stages = [("native", None), ("uuid", "uuid"), ("hash", "sha256")]
    for how, by in stages:
        if how == "native":
            if native is None:
                continue
            found = native.join(missing.select(F.col(key).alias("from_path")), "from_path", "left_semi").join(new.select(F.col(key).alias("to_path")), "to_path", "left_semi")
        else:
            big = (lambda df: df.where(F.col("size") >= LEAST_BYTES)) if how == "hash" else (lambda df: df)
            found = unique_matches(big(missing), big(new), by, key)
        found = found.select("from_path", "to_path").withColumn("how", F.lit(how))
        missing = missing.join(found.select(F.col("from_path").alias(key)), key, "left_anti")
        new = new.join(found.select(F.col("to_path").alias(key)), key, "left_anti")
        out = found if out is None else out.unionByName(found)
    return out


def repeated(df: DataFrame, by: str) -> DataFrame:
    n = F.count("*").over(Window.partitionBy(by))
    return df.where(F.col(by).isNotNull()).withColumn("__n", n).where("__n > 1").drop("__n")


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], version: str = "page_version") -> tuple[DataFrame, DataFrame]:
    """(rows after the changes, rejected changes). changes carry expected_version: null overwrites or inserts; a number must be the stored
    version, else the change is rejected. Accepted changes count the version up from the stored one, or from 0."""
    stored = base.select(*keys, F.col(version).alias("__stored"))
    met = changes.drop(version).join(stored, keys, "left")
    ok = F.col("expected_version").isNull() | F.col("expected_version").eqNullSafe(F.col("__stored"))
    taken = met.where(ok).withColumn(version, F.coalesce("__stored", F.lit(0)) + 1).drop("__stored", "expected_version")
    kept = base.join(taken.select(*keys), keys, "left_anti")
    return kept.unionByName(taken, allowMissingColumns=True), met.where(~ok).drop("__stored")


def prune(df: DataFrame, keys: list[str], order: list[Column], active: Column, keep: int, age_days: Column, ttl_days: int) -> DataFrame:
    """Active rows stay; of the others the newest `keep` per key that aren't older than ttl_days."""
    rn = F.row_number().over(Window.partitionBy(*keys, active).orderBy(*order))
    return df.withColumn("__rn", rn).where(active | ((F.col("__rn") <= keep) & (age_days <= ttl_days))).drop("__rn")


def newest(df: DataFrame, keys: list[str], id_col: str, *order: str) -> DataFrame:
    """keys + id_col: the id of the last row of each key in order. Aggregated before the exchange, so a hot key is no task's burden."""
    return df.groupBy(*keys).agg(F.max_by(id_col, F.struct(*order)).alias(id_col))


def rotate(imports: DataFrame, keys: list[str], id_col: str, *order: str) -> DataFrame:
    """imports with is_active: the last import of each key, and no other, is the active one."""
    last = newest(imports, keys, id_col, *order).select(id_col).withColumn("is_active", F.lit(True))
    return imports.join(last, id_col, "left").withColumn("is_active", F.coalesce("is_active", F.lit(False)))


def expired(rows: DataFrame, active: Column, age_days: Column, ttl_days: int) -> DataFrame:
    """Rows that aren't active and are older than ttl_days; a null age never expires."""
    return rows.where(~active & (age_days > ttl_days))


def replace_rows(base: DataFrame, gone: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """base without the keys of gone, and new. Keys of gone without new rows are deleted."""
    return base.join(gone.select(key).distinct(), key, "left_anti").unionByName(new)


def put_all(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """base with changes put over it by key, new keys included; a key should occur once in changes."""
    return base.join(changes.select(*keys), keys, "left_anti").unionByName(changes.select(*base.columns))


def claim(jobs: DataFrame, keys: list[str], most: int, *order: Column) -> DataFrame:
    """The first `most` jobs of each key in order. The limit is applied before the exchange and after it."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return jobs.withColumn("__rn", rn).where(F.col("__rn") <= most).drop("__rn")


def complete(jobs: DataFrame, reports: DataFrame, most_attempts: int) -> tuple[DataFrame, DataFrame]:
    """jobs (job_id, attempts, state) after reports (job_id, attempts, ok), and the refused reports.

    A report counts only if the job is running and has the number of attempts the reporter saw. A failed job waits again until
    it has had most_attempts; repeated reports of one attempt count once, and a failure among them counts as a failure.
    """
    once = reports.groupBy("job_id", "attempts").agg(F.min("ok").alias("ok"))
    met = jobs.join(once.withColumnRenamed("attempts", "seen"), (jobs["job_id"] == once["job_id"]) & (F.col("seen") == jobs["attempts"]) & (jobs["state"] == "running"), "left").select(jobs["*"], "ok")
    state = F.when(F.col("ok"), "done").when(~F.col("ok") & (F.col("attempts") >= most_attempts), "failed").when(~F.col("ok"), "pending").otherwise(F.col("state"))
    valid = jobs.where("state = 'running'").select("job_id", "attempts")
    return met.withColumn("state", state).drop("ok"), once.join(valid, ["job_id", "attempts"], "left_anti")


def orphans(jobs: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """Jobs whose owner isn't there any more."""
    return jobs.join(owners.select(key).distinct(), key, "left_anti")


def leases(jobs: DataFrame, ts: str, now: Column, seconds: int, spent: Column) -> DataFrame:
    """The jobs whose lease has run out, with their next state: failed if all attempts are spent, else pending."""
    late = F.timestamp_diff("MICROSECOND", F.col(ts), now) >= seconds * 1_000_000
    return jobs.where(late).withColumn("state", F.when(spent, "failed").otherwise("pending"))


def kept_days(rows: DataFrame, ts: str, now: Column, days: int) -> DataFrame:
    return rows.where(F.timestamp_diff("MICROSECOND", F.col(ts), now) <= days * 86_400_000_000)


def debounce(events: DataFrame, keys: list[str], ts: str, seconds: int) -> DataFrame:
    """keys + due: `seconds` after the last event of a key."""
    return events.groupBy(*keys).agg((F.max(ts) + F.expr(f"INTERVAL {seconds} SECOND")).alias("due"))


def batches(events: DataFrame, keys: list[str], ts: str, seconds: int, path: str) -> DataFrame:
    """keys + (batch, paths): the distinct paths touched in each stretch of `seconds`."""
    batch = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / seconds).alias("batch")
    return events.select(*keys, batch, path).groupBy(*keys, "batch").agg(F.countDistinct(path).alias("paths"))


def audit(stored: DataFrame, found: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, verdict) of every stored row: intact, changed, or missing, by comparing digests of whole contents."""
    other = found.select(key, F.col(digest).alias("__d"), F.lit(True).alias("__there"))
    verdict = F.when(F.col("__there").isNull(), "missing").when(F.col(digest).eqNullSafe(F.col("__d")), "intact").otherwise("changed")
    return stored.select(key, digest).join(other, key, "left").select(key, verdict.alias("verdict"))
