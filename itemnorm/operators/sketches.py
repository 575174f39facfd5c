"""Column profiles from sketches that are stored and merged.

A batch of rows gives one small row per column: counts, a HyperLogLog sketch of the distinct values and a sketch of the frequent
ones. Rows of several batches add up to the profile of all of them without another look at the data. Every batch
is scanned once, whatever the number of columns, and no value is grouped.

Distinct counts have a relative standard error of 1.04 / sqrt(2**lg) at most (1.6 % at lg 12); ``low`` and ``high`` are
three of them away. Counts of frequent values are exact while a column has at most ``track`` different values, and too low by
at most the rows over ``track`` times a small factor beyond. Null values count as nulls only.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG = 12
TRACK = 10_000


def profile_sketches(df: DataFrame, columns: list[str], lg: int = LG, track: int = TRACK) -> DataFrame:
    """(column, rows, nulls, distinct_sketch, top_sketch): one row per column of a batch."""
    text = df.select(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)])
    made = []
    for i in range(len(columns)):
        c = f"c{i}"
        made += [
            F.count(F.lit(1)).alias(f"rows{i}"), F.count_if(F.col(c).isNull()).alias(f"nulls{i}"),
            F.hll_sketch_agg(c, lg).alias(f"distinct{i}"), F.expr(f"approx_top_k_accumulate({c}, {track})").alias(f"top{i}"),
        ]
    one = text.agg(*made)
    parts = [
        F.struct(F.lit(c).alias("column"), F.col(f"rows{i}").alias("rows"), F.col(f"nulls{i}").alias("nulls"),
                 F.col(f"distinct{i}").alias("distinct_sketch"), F.col(f"top{i}").alias("top_sketch"))
        for i, c in enumerate(columns)
    ]
    return one.select(F.inline(F.array(*parts)))


def merge_sketches(sketches: DataFrame, track: int = TRACK) -> DataFrame:
    """The rows of several batches as one row per column."""
    return sketches.groupBy("column").agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.expr(f"approx_top_k_combine(top_sketch, {track})").alias("top_sketch"),
    )


def profile_of(sketches: DataFrame, k: int = 3, lg: int = LG) -> DataFrame:
    """(column, non_null, nulls, distinct_values, low, high, top): ``top`` holds the ``k`` most frequent (item, count)."""
    about = F.hll_sketch_estimate("distinct_sketch")
    off = 3 * 1.04 / math.sqrt(1 << lg)
    return sketches.select(
        "column", (F.col("rows") - F.col("nulls")).alias("non_null"), "nulls", about.alias("distinct_values"),
        F.floor(about * (1 - off)).alias("low"), F.ceil(about * (1 + off)).alias("high"),
        F.filter(F.expr(f"approx_top_k_estimate(top_sketch, {k + 1})"), lambda x: x["item"].isNotNull()).alias("top"),
    ).withColumn("top", F.slice("top", 1, k))
