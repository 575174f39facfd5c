"""A column normalizer that learns batch by batch.

The state holds the values with their counts, the cluster of every key, and the leaders of the clusters with an index of
their signatures, in buckets. A new batch counts its values, and only keys that have not been seen are settled: first against the
stored leaders that share one of their signatures, then among themselves. No key of an earlier batch is clustered again, and
canonical forms are chosen again only for clusters that the batch touches. As an earlier value never yields to
a later one, the result is that of learning everything in one go, if each batch comes after the earlier ones in the order.

    path/state/N/values|clusters|mapping    after batch N
    path/leaders/N, path/index/N            what batch N added, the index with its bucket as a column
    path/commit/N                           written last; a batch that dies before it has not been
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import key_fingerprint
from ..operators.clustering import KINDS, canonical_value, ngram_nodes, type_rule, value_counts
from ..operators.similarity import SIGNATURE, candidates, greedy_leaders, jaccard_verify, signatures
from ..session import cut, work_folder

BUCKETS = 64


@dataclass
class Learner:
    spark: SparkSession
    path: str
    kind: str = "generic"
    threshold: float = 0.85
    n: int = 2

    def _done(self) -> int:
        """The number of the last complete batch, 0 at the beginning."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        pattern = hadoop.Path(f"{self.path.rstrip('/')}/commit/*/_SUCCESS")
        found = pattern.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or []
        return max((int(str(s.getPath().getParent()).rsplit("/", 1)[1]) for s in found), default=0)

    def _at(self, kind: str, number: int) -> str:
        return f"{self.path.rstrip('/')}/{kind}/{number}"

    def _state(self, number: int, name: str, shape: str) -> DataFrame:
        read = self.spark.read.schema(shape)
        return read.parquet(f"{self._at('state', number)}/{name}") if number else self.spark.createDataFrame([], shape)

    def _bucket(self):
        return F.pmod(F.xxhash64(*SIGNATURE), F.lit(BUCKETS)).cast("int")

    def mapping(self) -> DataFrame:
        """(value, canonical) of all values learned so far."""
        return self._state(self._done(), "mapping", "value string, canonical string")

    def learn(self, df: DataFrame, column: str, order: str) -> DataFrame:
        """Take in a batch and return the mapping. Positions in ``order`` are whole numbers, and those of a batch are
        greater than all earlier ones. Blank values are not learned; an empty batch changes nothing."""
        if self.kind not in KINDS:
            raise ValueError(f"kind must be one of {KINDS}")
        folder, last = work_folder(self.spark), self._done()
        counts = value_counts(df, column, order).withColumn("key", key_fingerprint("value"))
        counts = cut(counts.select("value", "n", F.col("first_pos").cast("long").alias("first_pos"), "key"), folder, "counts")
        values = self._state(last, "values", "value string, n long, first_pos long, key string")
        clusters = self._state(last, "clusters", "key string, position long, cluster long")
        before = values.agg(F.count(F.lit(1)).alias("n"), F.max("first_pos").alias("pos")).first()
        first = counts.agg(F.min("first_pos")).first()[0]
        if first is None:
            return self.mapping()
        if before.pos is not None and first <= before.pos:
            raise ValueError("a batch must come after the earlier ones in the order")
        merged = values.unionByName(counts).groupBy("value").agg(F.sum("n").alias("n"), F.min("first_pos").alias("first_pos"), F.any_value("key").alias("key"))
        number = last + 1
        state = self._at("state", number)
        merged.write.mode("overwrite").parquet(f"{state}/values")
        merged = self.spark.read.parquet(f"{state}/values")

        keys = counts.groupBy("key").agg(F.min("first_pos").alias("position")).join(clusters.select("key"), "key", "left_anti")
        added = self._settle(cut(keys, folder, "keys"), folder, number, last)
        clusters.unionByName(added).write.mode("overwrite").parquet(f"{state}/clusters")
        every = self.spark.read.parquet(f"{state}/clusters")

        if merged.limit(2).count() < 2:  # a single value keeps its case unless a rule of its kind lowers it
            mapping = merged.select("value", type_rule(self.kind, F.col("value")).alias("canonical"))
        else:
            touched = counts.select("key").join(every, "key").select("cluster").distinct()
            inside = every if before.n <= 1 else every.join(touched, "cluster", "left_semi")
            inside = cut(merged.join(inside, "key").select("value", "n", "first_pos", "position", "cluster"), folder, "inside")
            forms = inside.groupBy("cluster").agg(canonical_value("value", "n", "position", "first_pos").alias("canonical"))
            new = inside.join(forms, "cluster").select("value", type_rule(self.kind, F.col("canonical")).alias("canonical"))
            mapping = self.mapping().join(inside.select("value"), "value", "left_anti").unionByName(new)
        mapping.write.mode("overwrite").parquet(f"{state}/mapping")
        self.spark.range(1).write.mode("overwrite").parquet(self._at("commit", number))
        return self.mapping()

    def _settle(self, keys: DataFrame, folder: str, number: int, last: int) -> DataFrame:
        """(key, position, cluster) of new keys (key, position); what they add to leaders and index is written."""
        marked, nodes = ngram_nodes(keys, "key", "position", self.n)
        shape = nodes.select("node", "tokens").schema
        known = [self._at("leaders", i) for i in range(1, last + 1)]
        leaders = self.spark.read.schema(shape).parquet(*known) if known else self.spark.createDataFrame([], shape)
        signed = cut(signatures(nodes, self.threshold).withColumn("bucket", self._bucket()), folder, "signed")
        met = [r.bucket for r in signed.select("bucket").distinct().collect()]  # BUCKETS at most
        found = None
        if known:
            index = self.spark.read.parquet(*[self._at("index", i) for i in range(1, last + 1)]).where(F.col("bucket").isin(met))
            pairs = candidates(index.select(*signed.columns), signed, self.threshold, folder=folder, name="stored")
            near = jaccard_verify(leaders.unionByName(nodes.select("node", "tokens")), self.threshold)(pairs)
            found = cut(near.groupBy("b").agg(F.min("a").alias("leader")).withColumnRenamed("b", "node"), folder, "found")
        rest = nodes if found is None else cut(nodes.join(found, "node", "left_anti"), folder, "rest")
        led = cut(greedy_leaders(rest, self.threshold, jaccard_verify(rest, self.threshold)), folder, "led")
        mine = rest.join(led.where("node = leader").select("node"), "node", "left_semi").select("node", "tokens")
        mine.write.mode("overwrite").parquet(self._at("leaders", number))
        own = signed.join(led.where("node = leader").select("node"), "node", "left_semi")
        own.repartition("bucket").write.mode("overwrite").parquet(self._at("index", number))
        led = led if found is None else led.unionByName(found.select("node", "leader"))
        of_gram = nodes.select("gram_key", "node").join(led, "node").select("gram_key", "leader")
        with_grams = marked.join(of_gram, "gram_key").select("key", "position", F.col("leader").alias("cluster"))
        alone = keys.where("key = ''").select("key", "position", F.col("position").alias("cluster"))
        return cut(with_grams.unionByName(alone), folder, "added")
