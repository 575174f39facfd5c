"""Reading text files of which some rows cannot be read.

A row that does not fit the schema, lacks a required value or is no record at all is not lost and stops nothing: it goes
to the failed rows with its text, its file and the reason. The source is read once; what was parsed is a written table from which
both parts are taken. Files are read line by line, so large ones are split among tasks; a record over several lines needs
``multiLine="true"``, which reads a file in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import blank
from ..session import cut, work_folder

CORRUPT = "_corrupt"
FILE = "_file"


@dataclass(frozen=True)
class Quarantined:
    """``good``: the rows of the schema; ``failed``: (record, file, reason)."""

    good: DataFrame
    failed: DataFrame


def read_quarantined(
    spark: SparkSession, path: str, schema: T.StructType | str, fmt: str, required: list[str] | None = None, **options: str
) -> Quarantined:
    """The rows of ``path`` (csv or json) that fit ``schema`` and have a value in every ``required`` column, and the others.

    The record of a row that could be read but lacks a value is the JSON of what was read."""
    if fmt not in ("csv", "json"):
        raise ValueError(f"rows of {fmt!r} files cannot fail one by one")
    shape = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    whole = T.StructType([*shape.fields, T.StructField(CORRUPT, T.StringType())])
    settings = {"header": "true", "escape": '"'} if fmt == "csv" else {}
    settings |= {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, **options}
    rows = spark.read.schema(whole).options(**settings).format(fmt).load(path)
    rows = cut(rows.withColumn(FILE, F.col("_metadata.file_path")), work_folder(spark), "parsed")
    names = shape.fieldNames()
    lacking = [F.when(blank(F.col(c).cast("string")), F.lit(c)) for c in required or []]
    lacks = F.concat_ws(", ", *lacking) if lacking else F.lit("")
    reason = F.when(F.col(CORRUPT).isNotNull(), F.lit("unreadable")).when(lacks != "", F.concat(F.lit("lacks "), lacks))
    judged = rows.withColumn("reason", reason)
    record = F.coalesce(F.col(CORRUPT), F.to_json(F.struct(*names)))
    return Quarantined(
        judged.where("reason is null").select(*names),
        judged.where("reason is not null").select(record.alias("record"), F.col(FILE).alias("file"), "reason"),
    )
