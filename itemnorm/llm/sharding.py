"""Shards by weighted rendezvous hashing of a stable record key.

Each record draws one number per shard from the hash of (key, shard) and goes to the shard with the largest
draw; weights bend the draws so that a shard gets its share. The draws of other shards do not change when one is
added, so a record either stays or moves into the new shard. The choice needs no shuffle and no other row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, number_within


def draw(key: Column, shard: int) -> Column:
    """A number in (0, 1) from the first 48 bits of md5(key/shard)."""
    digest = F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f"/{shard}"))), 1, 12)
    return (F.conv(digest, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 48))


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard of a key; ``weights`` has one positive number per shard. Null keys share the empty key's shard.
    Equal draws go to the smaller shard."""
    best = [
        F.struct((F.lit(float(w)) / -F.log(draw(key, i))).alias("draw"), F.lit(-i).alias("shard"))
        for i, w in enumerate(weights)
        if w > 0
    ]
    if not best:
        raise ValueError("at least one shard needs a positive weight")
    top = F.greatest(*best) if len(best) > 1 else best[0]
    return (-top["shard"]).cast("int")


def assign(docs: DataFrame, key: str, weights: list[float], shard: str = "shard") -> DataFrame:
    """``docs`` plus the shard of each row, in place of a column of that name; rows with equal keys share a shard."""
    return docs.withColumn(shard, rendezvous(F.col(key), weights))


def with_slots(docs: DataFrame, shard: str, order: list[str], slot: str = "slot", salts: int = 64) -> DataFrame:
    """``docs`` plus gapless positions from 0 within each shard, counted without gathering a shard in one task."""
    return number_within(docs, F.col(shard), [F.col(c) for c in order], slot, salts)


def write_shards(docs: DataFrame, key: str, weights: list[float], path: str, files_per_shard: int = 64) -> None:
    """Write every row under ``path/shard=N``. Rows of a shard are spread over ``files_per_shard`` tasks."""
    shard, part = fresh(docs, "shard"), fresh(docs, "_part")
    placed = assign(docs, key, weights, shard).withColumn(part, F.pmod(F.xxhash64(key), F.lit(files_per_shard)))
    placed.repartition(shard, part).drop(part).write.partitionBy(shard).parquet(path)
