"""Reading and writing item tables, taxonomies, keywords and mappings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank, strip
from ..operators.enrich import require_columns

FORMATS = ("parquet", "csv", "json", "orc")
# Without multiLine, large files are split among tasks; give it for records that go over several lines.
READ_OPTIONS = {"csv": {"header": "true", "inferSchema": "true", "escape": '"'}}


def _format_of(path: str, fmt: str | None) -> str:
    chosen = fmt or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if chosen not in FORMATS:
        raise ValueError(f"format {chosen!r} is not one of {FORMATS}")
    return chosen


def read_table(spark: SparkSession, path: str, fmt: str | None = None, schema=None, **options: str) -> DataFrame:
    """Read by format or by extension. Give a schema for large text files; inferring one reads them twice."""
    chosen = _format_of(path, fmt)
    settings = {**READ_OPTIONS.get(chosen, {}), **options}
    if schema is not None:
        settings.pop("inferSchema", None)
        return spark.read.schema(schema).options(**settings).format(chosen).load(path)
    return spark.read.options(**settings).format(chosen).load(path)


def read_items(spark: SparkSession, path: str, fmt: str | None = None, description: str = "Description", **options: str) -> DataFrame:
    return require_columns(read_table(spark, path, fmt, **options), description)


def write_table(df: DataFrame, path: str, fmt: str | None = None, mode: str = "errorifexists", **options: str) -> None:
    chosen = _format_of(path, fmt)
    settings = {"header": "true", "escape": '"', **options} if chosen == "csv" else options
    df.write.mode(mode).options(**settings).format(chosen).save(path)


def taxonomy(df: DataFrame) -> DataFrame:
    """``(category)`` paths from ``Category`` or from ``Level1`` and ``Level2``; a missing level drops the
    row, and so does a path that spells nan."""
    names = {c.lower(): c for c in df.columns}
    if "level1" in names and "level2" in names:
        levels = [strip(F.col(names[n]).cast("string")) for n in ("level1", "level2")]
        path = F.concat(levels[0], F.lit("|"), levels[1])
        return df.select(path.alias("category")).filter(~F.lower("category").contains("nan"))
    if "category" in names:
        path = strip(F.col(names["category"]).cast("string"))
        return df.select(path.alias("category")).filter(~blank("category"))
    raise ValueError("a taxonomy needs the column Category, or Level1 and Level2")


def attribute_sets(wide: DataFrame, set_column: str = "Attribute_Set") -> DataFrame:
    """``(attribute_set, ordinal, attribute)`` from one column per attribute; blank cells are left out."""
    slots = [f"Att{i}" for i in range(1, 9) if f"Att{i}" in wide.columns]
    long = wide.select(set_column, *slots).unpivot(set_column, slots, "slot", "attribute")
    return long.filter(~blank("attribute")).select(
        F.col(set_column).alias("attribute_set"),
        F.substring("slot", 4, 9).cast("int").alias("ordinal"),
        strip("attribute").alias("attribute"),
    )


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Finished versions of a stored table, oldest first."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    numbers = sorted(int(n[8:]) for n in names if n.startswith("version="))
    return [n for n in numbers if fs.exists(hadoop.Path(f"{folder}/version={n}/_SUCCESS"))]


def save_mapping(mapping: DataFrame, column_type: str, path: str) -> None:
    """Add a learned ``(value, canonical)`` mapping to those stored for its column type; a value learned again
    takes its new form. Each save is a new version, so a reader never meets a half-written one."""
    spark, folder = mapping.sparkSession, f"{path.rstrip('/')}/column_type={column_type}"
    new = mapping.select("value", "canonical")
    versions = _versions(spark, folder)
    if versions:
        new = new.unionByName(load_mapping(spark, path, column_type).join(new, "value", "left_anti"))
    new.write.parquet(f"{folder}/version={(versions or [0])[-1] + 1}")


def load_mapping(spark: SparkSession, path: str, column_type: str) -> DataFrame:
    """All that has been learned for a column type; empty if nothing has."""
    schema, folder = "value string, canonical string", f"{path.rstrip('/')}/column_type={column_type}"
    versions = _versions(spark, folder)
    if not versions:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/version={versions[-1]}")


def append_finished(df: DataFrame, path: str) -> None:
    """Add finished rows to the stored output; nothing already there is rewritten."""
    df.write.mode("append").parquet(path)
