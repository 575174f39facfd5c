"""Rendezvous shards: contract columns, weights, growth."""

import zlib
from collections import Counter

from pyspark.sql import functions as F

from itemnorm.llm import queries, sharding


def test_query(spark):
    rows = queries.op9_sharding(spark, "/root/testdata/sf0.1").collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").collect()}
    slots = {}
    for r in rows:
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw)) and r.law == "key" and 0 <= r.shard < 24
        assert r.grown_shard in (r.shard, 24)
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == len(docs) and all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 24
    moved = sum(r.grown_shard == 24 for r in rows)
    assert 0.6 * len(rows) / 25 < moved < 1.4 * len(rows) / 25


def test_weights_and_odd_rows(spark):
    ids = spark.range(20_000).withColumn("shard", F.lit("s"))
    n = Counter(r.place for r in sharding.assign(ids, "id", [1.0, 2.0, 0.0, 5.0], "place").collect())
    assert n[2] == 0 and abs(n[1] / n[0] - 2) < 0.25 and abs(n[3] / n[0] - 5) < 0.6
    odd = spark.createDataFrame([(None, "a"), (None, "b"), (1, None), (1, None)], "doc_id long, text string")
    placed = sharding.with_slots(sharding.assign(odd, "doc_id", [1.0] * 3), "shard", ["doc_id", "text"]).collect()
    assert len(placed) == 4 and len({r.shard for r in placed if r.doc_id is None}) == 1
    assert sharding.with_slots(sharding.assign(odd.limit(0), "doc_id", [1.0]), "shard", ["doc_id"]).count() == 0


def test_written_shards(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    path = str(tmp_path / "shards")
    sharding.write_shards(docs, "doc_id", [1.0] * 4, path, 2)
    back = spark.read.parquet(path)
    want = {r.doc_id: r.shard for r in sharding.assign(docs, "doc_id", [1.0] * 4).collect()}
    assert {r.doc_id: r.shard for r in back.collect()} == want
