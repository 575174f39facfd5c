"""Positions, samples and paged texts for tables without a row order of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, work_folder

ROW_BITS = 33  # monotonically_increasing_id keeps the partition above this bit


def with_position(df: DataFrame, order: list[Column | str], name: str = "Index", start: int = 1) -> DataFrame:
    """Number the rows 1..n in the given order without bringing them into one task.

    A range-partitioned sort is written with partition-local numbers; the offset of every partition comes
    from the partition sizes, one small row per partition."""
    folder = work_folder(df.sparkSession)
    marked = cut(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()), folder, "sorted")
    part = F.shiftright("_mid", ROW_BITS)
    sizes = marked.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    local = F.col("_mid").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    # One row per partition of the sort, so its size is bounded by the number of tasks.
    placed = marked.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return placed.select((local + F.col("_offset") + start).alias(name), *df.columns)


def add_index(df: DataFrame, order: list[Column | str], name: str = "Index") -> DataFrame:
    """Add a 1-based running number in the given order, unless the table already has one."""
    return df if name in df.columns else with_position(df, order, name)


def sample_rows(df: DataFrame, order: list[Column | str], n: int) -> DataFrame:
    """The first n rows in order, for a preview or a trial run."""
    return df.orderBy(*order).limit(n)


def first_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of every group. Spark prunes to k rows per group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def paged_text(df: DataFrame, key: str, order: list[Column], item: Column, separator: str, page_size: int) -> DataFrame:
    """``(key, page, text)``: the items of every group in order, joined by the separator.

    A group of up to ``page_size`` items is one text on page 0; a longer one continues on further pages,
    so that no task ever holds a whole large group and nothing is cut off."""
    placed = with_position(
        df.select(F.col(key), item.alias("_item"), *[o.alias(f"_o{i}") for i, o in enumerate(order)]),
        [key, *[f"_o{i}" for i in range(len(order))]],
        "_at",
        start=0,
    )
    firsts = placed.groupBy(key).agg(F.min("_at").alias("_first"))
    rank = F.col("_at") - F.col("_first")
    paged = placed.join(firsts, key).withColumn("page", F.floor(rank / page_size).cast("long"))
    texts = paged.groupBy(key, "page").agg(F.array_sort(F.collect_list(F.struct("_at", "_item"))).alias("_items"))
    return texts.select(key, "page", F.array_join(F.transform("_items", lambda x: x["_item"]), separator).alias("text"))
