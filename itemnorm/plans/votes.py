"""Category votes that follow changes of items without counting all of them again.

The state is a folder with the vote of every item, dealt into buckets by the item, and the tallies, dealt into buckets by the cluster key. A
change takes back what the item voted before and adds what it votes now; only the buckets that hold changed
items and touched keys are read and written again. A manifest says which write holds each bucket; it is written last, so a
change that dies leaves the state as it was, and applying the same change twice is the same as once.

    path/items/<call>/bucket=N     (item, key, category)
    path/tallies/<call>/bucket=N   (key, category, n)
    path/manifest/<number>         (kind, bucket, call)
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.consensus import consensus
from ..session import cut, work_folder

BUCKETS = 64
VOTES = "item long, key string, category string"
TALLIES = "key string, category string, n long"
SHAPES = {"items": (VOTES, "item"), "tallies": (TALLIES, "key")}


@dataclass
class VoteState:
    spark: SparkSession
    path: str
    buckets: int = BUCKETS

    def _bucket(self, column: str):
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def _manifest(self) -> tuple[int, dict[tuple[str, int], str]]:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        pattern = hadoop.Path(f"{self.path.rstrip('/')}/manifest/*/_SUCCESS")
        found = pattern.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or []
        numbers = [int(str(s.getPath().getParent()).rsplit("/", 1)[1]) for s in found]
        if not numbers:
            return 0, {}
        rows = self.spark.read.parquet(f"{self.path.rstrip('/')}/manifest/{max(numbers)}").collect()  # two per bucket at most
        return max(numbers), {(r.kind, r.bucket): r.call for r in rows}

    def _read(self, kind: str, held: dict, only: set[int] | None = None) -> DataFrame:
        shape, _ = SHAPES[kind]
        folders = [f"{self.path.rstrip('/')}/{kind}/{call}/bucket={b}" for (k, b), call in held.items() if k == kind and (only is None or b in only)]
        return self.spark.read.schema(shape).parquet(*folders) if folders else self.spark.createDataFrame([], shape)

    def _touched(self, df: DataFrame, column: str) -> set[int]:
        return {r[0] for r in df.select(self._bucket(column)).distinct().collect()}  # BUCKETS at most

    def apply(self, changes: DataFrame) -> DataFrame:
        """Take in ``changes`` (item, key, category) and return (key, winner) of the touched keys; winner is null where no
        category has more than half of the votes. A null key withdraws the item; a change without item counts for nothing, and of
        several changes of an item in one call the largest by key and category counts. A null category votes blank."""
        folder, call = work_folder(self.spark), uuid.uuid4().hex
        number, held = self._manifest()
        last = F.max(F.struct("key", F.coalesce("category", F.lit("")).alias("category"))).alias("last")
        given = changes.where("item is not null").groupBy(F.col("item").cast("long").alias("item")).agg(last)
        new = cut(given.select("item", "last.key", "last.category"), folder, "changes")
        items = self._touched(new, "item")
        before = self._read("items", held, items)
        back = before.join(new.select("item"), "item", "left_semi")
        step = new.where("key is not null").select("key", "category", F.lit(1).alias("n")).unionByName(back.select("key", "category", F.lit(-1).alias("n")))
        delta = cut(step.groupBy("key", "category").agg(F.sum("n").alias("n")), folder, "delta")
        keys = self._touched(delta, "key")
        tallies = self._read("tallies", held, keys).unionByName(delta).groupBy("key", "category").agg(F.sum("n").alias("n")).where("n > 0")
        votes = before.join(new.select("item"), "item", "left_anti").unionByName(new.where("key is not null"))
        written = {}
        for kind, rows in (("items", votes), ("tallies", tallies)):
            column = SHAPES[kind][1]
            to = f"{self.path.rstrip('/')}/{kind}/{call}"
            rows.withColumn("bucket", self._bucket(column)).repartition("bucket").write.partitionBy("bucket").parquet(to)
            written[kind] = self._touched(self.spark.read.schema(SHAPES[kind][0]).parquet(to), column)
        kept = {at: c for at, c in held.items() if at[1] not in {"items": items, "tallies": keys}[at[0]]}
        kept |= {(kind, b): call for kind, some in written.items() for b in some}
        rows = [(kind, b, c) for (kind, b), c in kept.items()]
        self.spark.createDataFrame(rows, "kind string, bucket int, call string").coalesce(1).write.mode("overwrite").parquet(
            f"{self.path.rstrip('/')}/manifest/{number + 1}"
        )
        now = self._read("tallies", kept, keys).join(delta.select("key").distinct(), "key", "left_semi")
        return delta.select("key").distinct().join(consensus(now, "key").select("key", "winner"), "key", "left")

    def decisions(self) -> DataFrame:
        """(key, winner, votes, voters) of every cluster in which more than half of the votes agree."""
        _, held = self._manifest()
        return consensus(self._read("tallies", held), "key").select("key", "winner", "votes", "voters")
