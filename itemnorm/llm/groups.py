"""Connected components of a graph given by its edges, as written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, remove


def shuffled(of: DataFrame) -> DataFrame:
    """``of`` for joins that must not broadcast it, though its file looks small enough; hot keys are split as ever."""
    return of.hint("merge")


def components(edges: DataFrame, folder: str, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a and b); root is the smallest node it is connected to.

    Each turn hooks the larger neighbours of a node, and then its smaller ones, to the smallest node around it,
    which leaves a star per component after a logarithmic number of turns. A hub's neighbours are never gathered:
    the minimum is an aggregation with map-side combine, written first, so that the rows meet it in a join of two
    plain shuffles, which Spark splits where a key is hot. Every turn is a written table; the one before it is removed.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    now, turn = cut(pairs, folder, f"{name}-0"), 0
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")), folder, f"{name}-{turn}-around")
        large = (
            shuffled(both.where("v > u"))
            .join(shuffled(least), "u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .where("u > v")
            .distinct()
        )
        large = cut(large, folder, f"{name}-{turn}-large")
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")), folder, f"{name}-{turn}-below")
        small = shuffled(large).join(shuffled(least), "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        turn += 1
        after = cut(small, folder, f"{name}-{turn}")
        for done in ("", "-large", "-around", "-below"):
            remove(spark, f"{folder}/{name}-{turn - 1}{done}")
        before, mark = mark, _mark(after)
        now = after
        if before == mark:
            break
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _mark(pairs: DataFrame) -> tuple:
    row = pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)
