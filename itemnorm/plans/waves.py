"""Asking an external classifier in waves that are kept, so that a run that dies loses no more than the wave it was in.

The rows to ask are dealt into waves by the hash of their key and written once, a folder per wave. A wave is one job, whose answers
go to a folder of their own; the marker that Spark leaves when a write is complete is the wave's commit. A later
call over the same store reads the committed answers, leaves out every row that has one, and asks the rest. What was
answered counts by key and request: if a row's request has changed, it is asked again.

    store/pending/<call>/wave=N     the rows of a call
    store/answers/<call>/wave=N     their answers, committed or not

A task that is lost within a wave is repeated by Spark and sends its requests again; nothing else is sent twice.
Keys must be unique and not null.
"""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.enrich import enrich

log = logging.getLogger(__name__)

ANSWER = ["content", "error", "input_tokens", "output_tokens"]
ASKED = "_asked"


def committed(spark: SparkSession, store: str) -> list[str]:
    """The folders of answers whose wave is complete."""
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store.rstrip('/')}/answers/*/wave=*/_SUCCESS")
    fs = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(str(s.getPath().getParent()) for s in fs.globStatus(pattern) or [])


def stored_answers(spark: SparkSession, store: str, key: str, kind: str) -> DataFrame:
    """(key, request mark, answer) of all committed waves."""
    schema = f"`{key}` {kind}, {ASKED} long, content string, error string, input_tokens long, output_tokens long"
    folders = committed(spark, store)
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def ask_in_waves(
    rows: DataFrame,
    classify: Callable,
    request: str,
    key: str,
    store: str,
    waves: int = 16,
    tasks: int | None = None,
    batch: int = 1,
    around: tuple[str, str] = ("", ""),
    retry_errors: bool = False,
) -> DataFrame:
    """``key`` and the answer (``ANSWER``) of every row of ``rows``, asked now or by an earlier call over ``store``.

    ``waves`` bounds what a failure can lose; rows with an error count as answered unless ``retry_errors``, and an
    answer goes before an error."""
    spark = rows.sparkSession
    kind = rows.schema[key].dataType.simpleString()
    mark: Column = F.xxhash64(F.lit(around[0]), F.col(request), F.lit(around[1]))
    asked = rows.select(key, request, mark.alias(ASKED))
    before = committed(spark, store)
    call = uuid.uuid4().hex
    if before:
        known = stored_answers(spark, store, key, kind)
        known = known.where("error is null") if retry_errors else known
        todo = asked.join(known.select(key, ASKED), [key, ASKED], "left_anti")
    else:
        todo = asked
    pending = f"{store.rstrip('/')}/pending/{call}"
    wave = F.pmod(F.xxhash64(key), F.lit(waves)).cast("int")
    todo.withColumn("wave", wave).write.partitionBy("wave").parquet(pending)
    for n in range(waves):
        part = _folder(spark, f"{pending}/wave={n}", todo.schema)
        if part is None:
            continue
        answered = enrich(part, classify, request, [key, ASKED], tasks, batch, around)
        answered.write.parquet(f"{store.rstrip('/')}/answers/{call}/wave={n}")
        log.info("wave %d of %d is committed", n + 1, waves)
    found = stored_answers(spark, store, key, kind)
    best = F.min(F.struct(F.col("error").isNotNull().alias("wrong"), *ANSWER)).alias("best")
    once = found.groupBy(key, ASKED).agg(best).select(key, ASKED, *(F.col(f"best.{c}").alias(c) for c in ANSWER))
    return asked.join(once, [key, ASKED]).select(key, *ANSWER)


def _folder(spark: SparkSession, path: str, schema) -> DataFrame | None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema(schema).parquet(path)
