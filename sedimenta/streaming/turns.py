"""Structured Streaming twins of the conversation operators: idle sessions, debounced jobs, deduplication and batch sinks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.conversation import merge_triggers
from ..session import shared_dir, ship


def read_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A table's files as a stream, with the schema they have now. path: a folder or one file.

    The path is given as a pattern that matches itself: only so does a file stream accept a single file.
    """
    schema = spark.read.parquet(path).schema
    r = spark.readStream.schema(schema)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(f"{path[:-1]}[{path[-1]}]")


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Everything that is there now, through to a table in the shared folder; offsets and state are kept there too."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/sedimenta/stream-{uuid.uuid4().hex}"
    names = stream.columns

    def put(batch: DataFrame, n: int) -> None:
        # A batch that is done again after a failure replaces what it wrote before.
        batch.select(*names).write.mode("overwrite").parquet(f"{base}/out/batch={n}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(put).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out/*")


def idle_sessions(events: DataFrame, key: str, ts: str, seconds: int, late: str = "1 minute") -> DataFrame:
    """key + (started, ended, n) of every session closed by a silence of `seconds` or more.

    Spark's session window still joins events exactly a gap apart, so the gap is a microsecond shorter.
    """
    gap = f"{seconds * 1_000_000 - 1} microseconds"
    w = events.withColumn("__t", F.col(ts).cast("timestamp")).withWatermark("__t", late)
    g = w.groupBy(key, F.session_window("__t", gap).alias("w")).agg(F.min("__t").alias("started"), F.max("__t").alias("ended"), F.count("*").alias("n"))
    return g.select(key, "started", "ended", "n")


def pending_jobs(requests: DataFrame, key: str, trigger: str, at: str, order: str) -> DataFrame:
    """key + (trigger, at) of the one pending job per key, updated with every batch: the same rules as the batch operator, in the requests' order."""
    ship(requests.sparkSession)

    def fold(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else None
        rows = pd.concat(list(frames)).sort_values(order)
        for t, a in zip(rows[trigger], rows[at]):
            now = (t, a) if now is None else merge_triggers(now, (t, a))
        state.update(now)
        yield pd.DataFrame({key: [k[0]], "trigger": [now[0]], "at": [now[1]]})

    kind = requests.schema[key].dataType.simpleString()
    return requests.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, trigger string, at string", "trigger string, at string", "update", GroupStateTimeout.NoTimeout)


def unseen(stream: DataFrame, keys: list[str], ts: str, within: str) -> DataFrame:
    """Rows whose keys weren't seen within a time."""
    return stream.withColumn("__t", F.col(ts).cast("timestamp")).withWatermark("__t", within).dropDuplicatesWithinWatermark(keys).drop("__t")


def for_each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None]) -> None:
    """Run work on every batch there is now (drains, diffs, embeddings). work must give the same result if it is done twice."""
    spark = stream.sparkSession
    state = f"{shared_dir(spark)}/sedimenta/stream-{uuid.uuid4().hex}/state"
    stream.writeStream.option("checkpointLocation", state).foreachBatch(work).trigger(availableNow=True).start().awaitTermination()
