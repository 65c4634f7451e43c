"""Physical-plan helpers: reading, spreading work, cutting lineage."""

from __future__ import annotations

import gc
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of (compressed) input one task of a CPU-bound Python stage should hold.
TASK_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table ``name`` of a data directory; timestamps are UTC."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of ``df`` in bytes; 0 where it has none."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # Connect sessions have no JVM plan
        return 0


def spread(df: DataFrame, *keys: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Spread a scan over enough tasks for a CPU-bound Python stage.

    A scan that already has three files for each core stays as it is; otherwise the rows are hashed by
    ``keys`` (a deterministic exchange, so a lost executor can be recomputed) into a number of partitions
    that follows the size of the input and the number of cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    try:
        files = len(df.inputFiles())
    except Exception:
        files = 0
    size = plan_bytes(df)
    if files >= 3 * cores and size / max(files, 1) <= 2 * task_bytes:
        return df
    n = max(3 * cores, -(-size // task_bytes) if size < 1 << 50 else 0)
    return df.repartition(int(n), *keys)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the session's ``spark.checkpoint.dir``; only where that is unset, on one machine, a temporary one.

    On a cluster without the setting it is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="tracewright-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Materialise ``df`` in the folder all executors share (:func:`shared_folder`) and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=eager)


def release(spark: SparkSession) -> None:
    """Let the files of exchanges and checkpoints that nothing refers to any more be deleted now.

    Spark deletes them when the driver's objects for them are collected, which it leaves to chance: a query in rounds would
    keep the files of all its rounds.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def hashed(*cols: str):
    """64-bit hash of columns, nulls included."""
    return F.xxhash64(*[F.col(c) for c in cols])


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once for a session.

    Does nothing where the workers find it by themselves: on PYTHONPATH, or on one machine in the working folder.
    """
    root = Path(__file__).resolve().parent.parent
    sc = spark.sparkContext
    paths = {str(Path(p).resolve()) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if str(root) in paths or sc.master.startswith("local[") and Path.cwd().resolve() == root:
        return
    if sc.applicationId in _shipped:
        return
    name = Path(tempfile.mkdtemp(prefix="tracewright-")) / "tracewright_package"
    files = sorted((root / "tracewright").rglob("*.py"))
    with zipfile.ZipFile(f"{name}.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for f in files:
            z.write(f, f.relative_to(root))
    sc.addPyFile(f"{name}.zip")
    _shipped.add(sc.applicationId)


_shipped: set[str] = set()
