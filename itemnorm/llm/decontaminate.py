"""Benchmark passages in documents by Wu-Manber multi-pattern search over words.

The alphabet is the word (its 64-bit hash), a pattern is a window of benchmark words. For patterns of m words and
blocks of B words, the shift table says for each block how far the search may move when that block ends at the
current position: m-B+1 when no pattern holds it, 0 when it ends a pattern. Only at shift 0 are the patterns with
that last block looked up by the hash of the whole window, and then compared word by word as bytes.

The search runs on many stretches of text at once: each numpy step moves every stretch by its own shift.
Windows of fewer words (items shorter than a window) are searched by tables of their own length.

The patterns are a stated query set: they are searched in blocks of a bounded number of windows, one pass over the
documents per block, so what is sent to the tasks stays bounded for any benchmark.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import GOLDEN, cut, fresh, hash_batch, hash_words, map_rows, mix, work_folder

WINDOW = 10
BLOCK = 3
BATCH_WINDOWS = 100_000
STRETCH = 256


def item_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct (window of lower-cased words joined by a blank, item). An item of fewer words is one window; an
    item without words, or null, has none."""

    def make():
        def work(ids, texts):
            found_ids, found = [], []
            for i, t in zip(ids, texts):
                blob = (t or "").encode()
                start, end, _ = hash_words(blob)
                low = blob.lower()
                words = [low[a:b] for a, b in zip(start.tolist(), end.tolist())]
                made = {b" ".join(words[k : k + window]).decode() for k in range(max(1, len(words) - window + 1))}
                found.append(sorted(made - {""}))
            return [pa.array(found, pa.list_(pa.string()))]

        return work

    adds = T.StructType([T.StructField("windows", T.ArrayType(T.StringType()))])
    made = map_rows(benchmark, [item, text], [item], adds, make)
    return made.select(F.explode("windows").alias("window"), F.col(item)).distinct()


class Patterns:
    """Shift tables and suffix buckets of the windows of one length."""

    def __init__(self, windows: list[bytes], numbers: list[int], length: int):
        self.m, self.b = length, min(BLOCK, length)
        self.words = [tuple(w.split(b" ")) for w in windows]
        self.numbers = numbers
        h = np.concatenate([hash_words(w)[2] for w in windows]).reshape(len(windows), length)
        whole = fold(h, length)[:, 0]
        self.buckets: dict[int, list[int]] = defaultdict(list)
        for i, x in enumerate(whole.tolist()):
            self.buckets[x].append(i)
        self.whole = np.unique(whole)
        bits = max(12, int(np.ceil(np.log2(len(windows) * length * 8))))
        self.down = np.uint64(64 - bits)
        self.shift = np.full(1 << bits, self.m - self.b + 1, np.uint8 if self.m < 250 else np.int64)
        blocks = (fold(h, self.b) >> self.down).astype(np.int64)
        for j in range(blocks.shape[1]):
            np.minimum.at(self.shift, blocks[:, j], self.m - self.b - j)

    def search(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Positions where some window may start, given word hashes and the first word of each text (and the end).
        Every text is cut into stretches that overlap by m-1 words."""
        at, stop = [], []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= self.m:
                s = np.arange(a + self.m - 1, b, STRETCH)
                at.append(s)
                stop.append(np.minimum(s + STRETCH, b))
        if not at:
            return np.zeros(0, np.int64)
        at, stop = np.concatenate(at), np.concatenate(stop)  # at: the last word of the place looked at
        found = []
        while at.size:
            block = h[at - self.b + 1]
            for j in range(self.b - 2, -1, -1):
                block = chain(block, h[at - j])
            step = self.shift[(block >> self.down).astype(np.int64)]
            zero = at[step == 0]
            if zero.size:
                found.append(zero)
            at = at + np.maximum(step, 1)
            go = at < stop
            at, stop = at[go], stop[go]
        return np.concatenate(found) - (self.m - 1) if found else np.zeros(0, np.int64)

    def confirm(self, text: bytes, start, end, h, places: np.ndarray) -> list[tuple[int, int]]:
        """(first word, window number) of the places that hold a window: its hash selects the bucket, the words
        decide."""
        if not places.size:
            return []
        value = h[places]
        for j in range(1, self.m):
            value = chain(value, h[places + j])
        spot = np.minimum(np.searchsorted(self.whole, value), self.whole.size - 1)
        same = self.whole[spot] == value
        out = []
        for p, x in zip(places[same].tolist(), value[same].tolist()):
            words = tuple(text[a:b].lower() for a, b in zip(start[p : p + self.m].tolist(), end[p : p + self.m].tolist()))
            out += [(p, self.numbers[i]) for i in self.buckets[x] if self.words[i] == words]
        return out


def chain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix((a + GOLDEN) ^ (b * np.uint64(0xD6E8FEB86659FD93)))


def fold(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` columns."""
    k = h.shape[1] - n + 1
    value = h[:, :k]
    for j in range(1, n):
        value = chain(value, h[:, j : j + k])
    return value


def finder(windows: list[tuple[str, int]]) -> Callable:
    """A function from texts to (n_words, occurrences of each text as (first word, n words, window number))."""
    by_length: dict[int, list[tuple[bytes, int]]] = defaultdict(list)
    for w, number in windows:
        by_length[w.count(" ") + 1].append((w.encode(), number))
    tables = [Patterns([w for w, _ in x], [n for _, n in x], m) for m, x in sorted(by_length.items())]

    def find(texts: list[str | None]):
        joined, start, end, h, first = hash_batch(texts)
        hits: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for t in tables:
            for p, number in t.confirm(joined, start, end, h, t.search(h, first)):
                doc = int(np.searchsorted(first, p, "right")) - 1
                hits[doc].append((p - int(first[doc]), t.m, number))
        return np.diff(first), hits

    return find


def occurrences(docs: DataFrame, benchmark: DataFrame, item: str = "item_id", text: str = "text") -> tuple[DataFrame, str]:
    """Every column of ``docs`` plus a struct ``found``: ``n_words``, word ``spans`` (first, end) covered by
    windows, merged and in order, and the sorted ``items`` whose windows occur. Null and empty texts have no words.
    Also the folder with the work tables.

    The windows are written once and searched in blocks of ``BATCH_WINDOWS``.
    """
    spark = docs.sparkSession
    folder = work_folder(spark)
    windows = cut(item_windows(benchmark, item), folder, "windows")
    grouped = windows.groupBy("window").agg(F.sort_array(F.collect_set(F.col(item).cast("string"))).alias("items"))
    numbered = cut(
        grouped.withColumn("block", F.pmod(F.xxhash64("window"), F.lit(max(1, -(-windows.count() // BATCH_WINDOWS))))),
        folder,
        "blocks",
    )
    blocks = sorted(r.block for r in numbered.select("block").distinct().collect()) or [0]
    found = fresh(docs, "found")
    kind = T.StructType(
        [
            T.StructField("n_words", T.LongType()),
            T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
            T.StructField("items", T.ArrayType(T.StringType())),
        ]
    )
    out = docs
    for block in blocks:
        part = [(r.window, r["items"]) for r in numbered.where(F.col("block") == block).collect()]
        shared = spark.sparkContext.broadcast(part)
        out = _pass(out, text, found, kind, shared)
    return out, found


def _pass(docs: DataFrame, text: str, found: str, kind: T.StructType, shared) -> DataFrame:
    """One block of windows; joins what an earlier block found."""
    again = found in docs.columns
    keeps = [c for c in docs.columns if c != found]

    def make():
        find = finder([(w, i) for i, (w, _) in enumerate(shared.value)])
        items = [x for _, x in shared.value]

        def work(texts, before=None):
            n, hits = find(texts)
            made = []
            for k, own in enumerate(hits):
                earlier = before[k] if before else None
                spans = sorted([(a, a + m) for a, m, _ in own] + [tuple(s) for s in (earlier["spans"] if earlier else ())])
                names = set().union(*[items[w] for w in {w for _, _, w in own}], earlier["items"] if earlier else ())
                made.append({"n_words": int(n[k]), "spans": merged(spans), "items": sorted(names)})
            return [pa.array(made, pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))]))]

        return work

    return map_rows(docs, [text, found] if again else [text], keeps, T.StructType([T.StructField(found, kind)]), make)


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def report(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document: words, words inside occurrences, items that occur, and whether any does."""
    out, found = occurrences(docs.select(key, "text"), benchmark)
    f = F.col(found)
    n_hit = F.aggregate(f["spans"], F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return out.select(
        F.col(key),
        f["n_words"].alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(f["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(f["items"], ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the documents in which a benchmark window occurs; columns unchanged."""
    out, found = occurrences(docs, benchmark, text=text)
    return out.where(F.size(F.col(found)["spans"]) == 0).select(*docs.columns)
