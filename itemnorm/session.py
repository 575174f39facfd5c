"""Session settings and lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("itemnorm")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@lru_cache(maxsize=1)
def _local_base() -> str:
    """A folder for the work tables of this process's local session; it goes when the process ends."""
    made = tempfile.mkdtemp(prefix="itemnorm-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return made


#: The folder that passed its trial, by application and the folder asked for.
_TRIED: dict[tuple[str, str], str] = {}


def work_folder(spark: SparkSession) -> str:
    """A new sub-folder of a folder that all executors share.

    That is the one ``spark.checkpoint.dir`` names, else the checkpoint folder of the context, else the warehouse; a local
    session without the first two keeps its work tables in a folder of its process. On a cluster of machines a path of
    the local file system may be a shared mount or not, so unless ``spark.checkpoint.dir`` names its scheme, it is tried
    once, and the warehouse takes its place if it is not shared. What is put into the warehouse goes when the session's JVM ends.
    """
    context = spark.sparkContext
    cluster = not context.master.startswith("local") or context.master.startswith("local-cluster")
    named = spark.conf.get("spark.checkpoint.dir", None)
    base = named or context.getCheckpointDir()
    if not cluster:
        base = base or _local_base()
    elif not (named and "://" in named):
        base = _shared(spark, base)
    return f"{base.rstrip('/')}/itemnorm-{uuid.uuid4().hex}"


def _shared(spark: SparkSession, base: str | None) -> str:
    """``base`` if driver and tasks share it, else a folder in the warehouse, which goes with the session's JVM."""
    context = spark.sparkContext
    asked = (context.applicationId, base or "")
    if asked in _TRIED:
        return _TRIED[asked]
    warehouse, failures = spark.conf.get("spark.sql.warehouse.dir"), []
    own = warehouse and f"{warehouse.rstrip('/')}/itemnorm-{context.applicationId}"
    for folder in filter(None, (base, own)):
        try:
            _try_folder(spark, folder, passing=folder == own)
        except RuntimeError as failure:
            failures.append(failure)
        else:
            _TRIED[asked] = folder
            return folder
    raise failures[0]


def _try_folder(spark: SparkSession, base: str, passing: bool = False) -> None:
    """Check that the driver sees what tasks write into a folder of the local file system; a ``passing`` one goes with the JVM."""
    context = spark.sparkContext
    seen = n = context.defaultParallelism
    path = f"{base.rstrip('/')}/itemnorm-{uuid.uuid4().hex}"
    try:
        top = context._jvm.org.apache.hadoop.fs.Path(base)
        files = top.getFileSystem(context._jsc.hadoopConfiguration())
        if files.getScheme() == "file":
            spark.range(0, n, 1, n).write.parquet(path)
            seen = spark.read.schema("id long").parquet(path).count()
            files.delete(context._jvm.org.apache.hadoop.fs.Path(path), True)
        if passing:
            files.mkdirs(top)
            files.deleteOnExit(top)
    except Exception as failure:
        raise RuntimeError(f"tasks cannot write to {base}; set spark.checkpoint.dir to a folder shared by all executors") from failure
    if seen < n:
        raise RuntimeError(f"{base} is a folder of one machine; set spark.checkpoint.dir to a folder shared by all executors")


def cut(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write ``df`` to a table in ``folder`` and read it back: a short lineage that survives the loss
    of executors, with real sizes for the planner."""
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
