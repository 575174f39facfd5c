"""Importance resampling towards a target collection, with weights by bit-sliced aggregation.

Features are the runs of one to ``runs`` consecutive words, hashed into buckets by crc32. The gain of a bucket is the
scaled logarithm of its smoothed share in the target over that in the source, an integer; the weight of a document is
the sum of the gains of its features. It is taken without a multiplication: bit p of a document's bucket counts forms
one plane of as many bits as there are buckets, bit k of the gains (two's complement) another, and
    weight = sum over p and k of 2**(p + k) * popcount(counts_p AND gains_k),
with a negative sign for the topmost gain plane. All sums are integers, so no order of adding changes a result.

The documents drawn are the highest of weight + Gumbel noise from a hash of the key, which is a draw without replacement
in proportion to exp(weight / scale).

Two narrow scans read the texts, one for the counts of all buckets, one for the weights; a task sends one row per bucket
at most. The gains, one number per bucket, are the only thing the driver holds. Running numbers for the order come
from a range sort, so a draw of any size needs no single task.

Null and empty texts have no words, no features and weight 0. A null key is read as the empty key. Rows alike in key and
text are scored alike and ranked apart; equal scores go by the smaller key, then the smaller text. Other columns are not read.
Empty documents give an empty result, an empty target one in which every gain counts against 0 target features.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itemnorm.operators.ordering import with_position

from .common import cut, hash_batch, map_rows, work_folder

BUCKETS = 10_000
RUNS = 1
SCALE = 1000
#: Words of more bytes are summed one by one.
LONG = 48
#: Documents whose planes are held at a time.
TOGETHER = 64


def _table() -> np.ndarray:
    """What crc32 does to a byte, by its polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_TABLE = _table()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _more(state: np.ndarray, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """crc32 states after the bytes ``low[start:end]`` of each word."""
    state, size = state.copy(), end - start
    for i in np.flatnonzero(size > LONG):
        state[i] = ~np.uint32(zlib.crc32(low[start[i] : end[i]].tobytes(), int(~state[i])))
    open_ = np.flatnonzero(size <= LONG)
    k = 0
    while True:
        open_ = open_[size[open_] > k]
        if not open_.size:
            return state
        s = state[open_]
        state[open_] = _TABLE[(s ^ low[start[open_] + k]) & np.uint32(255)] ^ (s >> np.uint32(8))
        k += 1


def features(texts: list[str | None], runs: int = RUNS, buckets: int = BUCKETS):
    """(text number, bucket) of every feature of the texts, and the number of words of each text."""
    joined, start, end, _, first = hash_batch(texts)
    n_words = np.diff(first)
    low = _LOWER[np.frombuffer(joined, np.uint8)]
    text = np.repeat(np.arange(len(texts)), n_words)
    last = np.repeat(first[1:], n_words)  # the word after a text's last one
    at = np.arange(start.size)
    state = np.full(start.size, 0xFFFFFFFF, np.uint32)
    of, found = [], []
    for r in range(runs):
        if r:
            whole = at + r < last[at]
            at, state = at[whole], state[whole]
            state = _TABLE[(state ^ np.uint32(32)) & np.uint32(255)] ^ (state >> np.uint32(8))
        state = _more(state, low, start[at + r], end[at + r])
        of.append(text[at])
        found.append((~state).astype(np.int64) % buckets)
    return np.concatenate(of), np.concatenate(found), n_words


def bucket_counts(docs: DataFrame, text: str = "text", runs: int = RUNS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all texts; a task sends its sums, one row per bucket that it has met."""

    def run(batches):
        from .common import _parts

        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in _parts(batch, [0]):
                total += np.bincount(features(part.column(0).to_pylist(), runs, buckets)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    return docs.select(text).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS, scale: int = SCALE) -> np.ndarray:
    """The gain of every bucket from its counts (bucket, n) in both; ``buckets`` numbers reach the driver."""
    every = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    both = both.select("bucket", *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t"))).toPandas()
    s, t = (both.sort_values("bucket")[c].to_numpy() for c in ("s", "t"))
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(scale * np.log(ratio)).astype(np.int64)


def planes(counts: np.ndarray, width: int) -> np.ndarray:
    """The lowest ``width`` bits of the integers in the last axis, a plane of bits each: (..., width, words)."""
    pad = -counts.shape[-1] % 64
    if pad:
        counts = np.concatenate([counts, np.zeros((*counts.shape[:-1], pad), counts.dtype)], -1)
    bits = [np.packbits((counts >> k).astype(np.uint8) & 1, axis=-1, bitorder="little") for k in range(width)]
    return np.stack(bits, -2).view(np.uint64)


class Gains:
    """The gains as signed bit planes."""

    def __init__(self, gain: np.ndarray):
        self.width = int(max(gain.max(initial=0), -gain.min(initial=0) - 1)).bit_length() + 1
        self.planes = planes(gain, self.width)
        self.worth = 1 << np.arange(self.width, dtype=np.int64)
        self.worth[-1] *= -1

    def weights(self, of: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        """The weights of ``n`` documents from the (document, bucket) of their features, sorted by document."""
        words = self.planes.shape[-1]
        out = np.zeros(n, np.int64)
        for a in range(0, n, TOGETHER):
            m = min(TOGETHER, n - a)
            i, j = np.searchsorted(of, [a, a + m])
            cells = (of[i:j] - a) * (words * 64) + bucket[i:j]
            counts = np.bincount(cells, minlength=m * words * 64).reshape(m, -1)
            depth = int(counts.max(initial=0)).bit_length()
            own = planes(counts, depth) if depth else np.zeros((m, 0, words), np.uint64)
            size = 1 << np.arange(depth, dtype=np.int64)
            for gain, worth in zip(self.planes, self.worth):
                ones = np.bitwise_count(own & gain).sum(-1, dtype=np.int64)
                out[a : a + m] += worth * (ones @ size)
        return out


def weigh(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", runs: int = RUNS, keep: list[str] | None = None) -> DataFrame:
    """``key`` (and the columns ``keep``) with n_words, n_features and weight of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def make():
        gained, buckets = Gains(sent.value), sent.value.size

        def work(texts):
            of, bucket, n_words = features(texts, runs, buckets)
            if runs > 1:
                order = np.argsort(of, kind="stable")
                of, bucket = of[order], bucket[order]
            n = np.bincount(of, minlength=len(texts))
            return [pa.array(x, pa.int64()) for x in (n_words, n, gained.weights(of, bucket, len(texts)))]

        return work

    adds = T.StructType([T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")])
    return map_rows(docs, [text], [key, *(keep or [])], adds, make)


def noise(key: str, seed: int, scale: int = SCALE):
    """Scaled Gumbel noise, rounded down, from the first 32 bits of sha256(seed:key)."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("long").cast("double")
    return F.floor(-F.lit(float(scale)) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, key: str = "doc_id", text: str = "text", target_text: str = "text",
    runs: int = RUNS, buckets: int = BUCKETS, scale: int = SCALE, seed: int = 2024, least_words: int = 20,
) -> DataFrame:
    """Per document: ``key``, n_words, n_features, weight, score and rank: 1, 2, ... for the ``percent`` highest of
    the documents with at least ``least_words`` words, null for the others."""
    folder = work_folder(docs.sparkSession)
    gain = gains(bucket_counts(docs, text, runs, buckets), bucket_counts(target, target_text, runs, buckets), buckets, scale)
    kept = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("tie"))
    scored = weigh(kept, gain, "key", "text", runs, keep=["tie"])
    scored = cut(scored.withColumn("score", F.col("weight") + noise("key", seed, scale)), folder, "scored")
    able = scored.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    placed = with_position(able, [F.desc("score"), "key", "tie"], "rank")
    rank = F.when(F.col("rank") <= drawn, F.col("rank")).cast("long").alias("rank")
    few = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    out = placed.select(*scored.columns, rank).unionByName(few)
    return out.select(F.col("key").alias(key), "n_words", "n_features", "weight", "score", "rank")
