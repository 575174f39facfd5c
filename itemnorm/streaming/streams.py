"""Structured Streaming forms of mapping application and of the resumable output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.clustering import apply_mapping


def item_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """Items from files that arrive in a folder."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def apply_mapping_stream(stream: DataFrame, column: str, mapping: DataFrame, output: str) -> DataFrame:
    """Stream-static left join with a learned mapping; keeps no state."""
    return apply_mapping(stream, column, mapping, output)


def append_stream(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append a stream to a parquet table, each input row exactly once."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start() if available_now else writer.start()


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def process_stream(
    stream: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, key: str = "Index",
    finished: DataFrame | None = None, event_time: str | None = None, delay: str = "7 days",
) -> StreamingQuery:
    """Run ``work`` on the rows of every batch whose key has not come before, and store its result in a folder of its own.

    Which keys have come is state of the stream, kept by key in the state store on the executors' disks and in the checkpoint,
    so a batch never reads what earlier ones stored. It lasts as long as the checkpoint; with ``event_time``, keys are forgotten
    ``delay`` after their time, which bounds the state where repeats come soon. ``finished`` holds rows of other runs to leave
    out. A batch that is repeated after a failure overwrites its own folder, so every key is stored once. ``work`` keeps ``key``;
    rows with a null key are one key."""
    spark = stream.sparkSession
    if finished is not None:
        known = finished.select(F.col(key).alias("_known")).distinct()
        stream = stream.join(known, F.col(key) == F.col("_known"), "left_outer").where("_known is null").drop("_known")
    if event_time:
        fresh = stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])
    else:
        fresh = stream.dropDuplicates([key])

    def store(batch: DataFrame, batch_id: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")

    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKS)  # read when the stream starts; keys beyond memory stay on disk
    try:
        writer = fresh.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
        return writer.trigger(availableNow=True).start()
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


def _parts(spark: SparkSession, path: str) -> tuple[list[tuple[int, str]], tuple[int, str] | None]:
    """Number and folder of every complete batch that is not in the last complete compaction, and that compaction."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    pattern = hadoop.Path(f"{path.rstrip('/')}/*=*/_SUCCESS")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or []
    folders = [str(s.getPath().getParent()) for s in found]
    named = [(f.rsplit("/", 1)[1].split("="), f) for f in folders]
    upto = max(((int(n), f) for (kind, n), f in named if kind == "upto"), default=None)
    batches = sorted((int(n), f) for (kind, n), f in named if kind == "batch" and (upto is None or int(n) > upto[0]))
    return batches, upto


def finished_rows(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows stored so far; None if no batch has stored rows."""
    batches, upto = _parts(spark, path)
    folders = ([upto[1]] if upto else []) + [f for _, f in batches]
    return spark.read.parquet(*folders) if folders else None


def compact(spark: SparkSession, path: str, files: int, keep: int = 1) -> int:
    """Rewrite the stored batches but the last ``keep`` as one table of ``files`` files, and return their number.

    The new table counts as soon as its write is complete, and from then on stands for its batches, whose folders are
    removed last; a compaction that dies changes nothing. The last batches stay, as a stream may write them again."""
    batches, upto = _parts(spark, path)
    old = batches[: max(len(batches) - keep, 0)]
    if not old:
        return 0
    folders = ([upto[1]] if upto else []) + [f for _, f in old]
    spark.read.parquet(*folders).repartition(files).write.mode("overwrite").parquet(f"{path.rstrip('/')}/upto={old[-1][0]}")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for folder in folders:
        at = hadoop.Path(folder)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return len(old)
