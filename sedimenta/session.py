"""Session helpers: building a local session, shipping the package, cutting lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_shipped: set[str] = set()
_written: list[tuple[SparkSession, str]] = []


def local_session(cpus: int = 8, app: str = "sedimenta", memory: str = "8g", **conf: str) -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, so that its functions can be unpickled there."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="sedimenta-")) / "sedimenta_pkg.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    sc.addPyFile(str(out))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir where the cluster names one, else a temporary one in local mode (tests).

    Off local mode a folder must be named: a temporary one would be another folder on every machine.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        named = sc.getCheckpointDir()
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = named or "file://" + tempfile.mkdtemp(prefix="sedimenta-shared-")
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
    return named.rstrip("/")


def materialize(df: DataFrame, label: str = "stage", by: list[str] | None = None) -> DataFrame:
    """Write df as a compressed table in the shared folder and read it back.

    This cuts the lineage in a way that survives the loss of any executor: what was written is re-read, not recomputed.
    The tables are removed by free() as soon as an operator needs them no more, else by release() or when the driver ends.
    """
    return measured(df, label, by)[0]


def measured(df: DataFrame, label: str = "stage", by: list[str] | None = None, **metrics: Column) -> tuple[DataFrame, dict]:
    """materialize(), and aggregates over the rows that are counted while they are written. by: columns whose values are folders, the last ones."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sedimenta/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    seen = Observation(f"o{uuid.uuid4().hex}") if metrics else None
    out = df.observe(seen, *(c.alias(k) for k, c in metrics.items())) if seen else df
    writer = out.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    _written.append((spark, path))
    back = spark.read.schema(df.schema).parquet(path)
    back._sedimenta_path = path
    return back, dict(seen.get) if seen else {}


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone; the folder belongs to the cluster
        pass


def free(*tables: DataFrame) -> None:
    """Remove tables of materialize() that nothing will read again (those of past rounds)."""
    for t in tables:
        path = getattr(t, "_sedimenta_path", None)
        for held in [x for x in _written if x[1] == path]:
            _remove(*held)
            _written.remove(held)


def release(spark: SparkSession | None = None) -> None:
    """Remove the tables that materialize() wrote (of one session, or of all)."""
    keep = []
    for s, path in _written:
        if spark is not None and s is not spark:
            keep.append((s, path))
        else:
            _remove(s, path)
    _written[:] = keep


@atexit.register
def _at_exit() -> None:
    left = list(_written)
    release()
    for _, path in left:
        if os.path.isdir(local := path.removeprefix("file://")):
            shutil.rmtree(local, ignore_errors=True)


def shuffle_parts(spark: SparkSession) -> int:
    """The number of shuffle partitions the session asks for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
