"""Near-duplicate documents by ProbMinHash over weighted word shingles.

A text is the bag of its runs of five lower-cased words; a run's weight is how often it occurs. In a signature every
run sends arrivals of a Poisson process with its weight as rate, each to a random register; a register keeps the run
of its earliest arrival, and a run stops as soon as its next arrival is later than every register's earliest. Two
signatures agree in a register with the probability Jaccard similarity J of the two bags (for equal weights the
plain Jaccard similarity). Bands of registers propose pairs, the exact J of the bags decides.

Equal word sequences are one class from the start. Classes that share a band are candidates. A class whose runs occur
in other candidates by less than the threshold (by weight) has no partner, since J is at most that share; it leaves.
In every band the class whose runs are the most frequent ones stands in the middle of its copies: it is compared
with all others of the band first. Classes that this has joined need no further comparison; what is still apart and
shares a band is compared in pairs. So no group of copies is expanded into all its pairs, and none is gathered.

Null texts and texts without words resemble nothing. Texts of fewer than five words are one run. Rows with a null id
take part; they have the largest id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import GOLDEN, cut, fresh, hash_batch, map_rows, mix, work_folder
from .groups import components

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 5
BITS = 1024


def shingles(h: np.ndarray, first: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and count of the distinct runs of ``n`` words; ``first`` has each text's first word."""
    size = np.diff(first)
    text = np.repeat(np.arange(size.size), size)
    place = np.arange(h.size) - np.repeat(first[:-1], size)
    value = h.copy()
    for j in range(1, n):
        ok = place + j < size[text]
        value[ok] = mix(value[ok] + GOLDEN) ^ h[np.flatnonzero(ok) + j]
    starts = (place <= size[text] - n) | ((size[text] < n) & (place == 0))
    text, value = text[starts], value[starts]
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(value.size, bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return text[at], value[at], np.diff(np.append(at, value.size))


def signatures(text: np.ndarray, run: np.ndarray, weight: np.ndarray, n: int, registers: int) -> np.ndarray:
    """The run that reaches each register first, for ``n`` texts at once. Texts without runs keep zeros."""
    earliest = np.full(n * registers, np.inf)
    winner = np.zeros(n * registers, np.uint64)
    rate = weight.astype(float)
    time = np.zeros(run.size)
    turn = 0
    while run.size:
        draw = mix(run + np.uint64((2 * turn + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        time = time - np.log((draw >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54) / rate
        spot = text * registers + (mix(draw + GOLDEN) % np.uint64(registers)).astype(np.int64)
        better = time < earliest[spot]
        np.minimum.at(earliest, spot[better], time[better])
        won = time == earliest[spot]
        winner[spot[won]] = run[won]
        last = earliest.reshape(n, registers).max(axis=1)
        on = time < last[text]
        text, run, rate, time = text[on], run[on], rate[on], time[on]
        turn += 1
    return winner.reshape(n, registers)


def bands(winner: np.ndarray, count: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One number per band; the same runs in the same registers give the same number."""
    w = winner.reshape(len(winner), count, rows)
    value = np.broadcast_to(mix(np.arange(1, count + 1, dtype=np.uint64) * GOLDEN), w.shape[:2])
    for j in range(rows):
        value = mix((value + GOLDEN) ^ w[:, :, j])
    return value.astype(np.int64)


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Probability Jaccard of two bags (sorted runs and weights):
    the sum over common d of 1 / sum over e of max(a_e/a_d, b_e/b_d)."""
    both, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not both.size:
        return 0.0
    x, y = wa[ia].astype(float), wb[ib].astype(float)
    only_a, only_b = float(wa.sum()) - x.sum(), float(wb.sum()) - y.sum()
    ratio = y / x
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    upto = np.searchsorted(ratio, ratio, "right")
    sum_x = np.concatenate([[0.0], np.cumsum(x)])[upto]
    sum_y = y.sum() - np.concatenate([[0.0], np.cumsum(y)])[upto]
    return float((1 / ((only_a + sum_x) / x + (only_b + sum_y) / y)).sum())


def prints(docs: DataFrame, text: str, keeps: list[str]) -> DataFrame:
    """``keeps`` plus a row number, the digest of the word sequence (null without words) and the bands."""

    def make():
        def work(texts):
            _, _, _, h, first = hash_batch(texts)
            blob, cuts = h.tobytes(), (first * 8).tolist()
            digest = [hashlib.blake2b(blob[a:b], digest_size=16).digest() if b > a else None for a, b in zip(cuts, cuts[1:])]
            made = bands(signatures(*shingles(h, first), len(texts), BANDS * ROWS))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * BANDS, pa.int32()), pa.array(made.ravel()))
            return [pa.array(digest, pa.binary()), lists]

        return work

    adds = T.StructType([T.StructField("_content", T.BinaryType()), T.StructField("_bands", T.ArrayType(T.LongType()))])
    return map_rows(docs, [text], keeps, adds, make).withColumn("_row", F.monotonically_increasing_id())


def parities(text: np.ndarray, run: np.ndarray, n: int) -> np.ndarray:
    """``BITS`` bits per text: whether an odd number of its runs falls on the bit. Two texts differ in at most as many
    bits as there are runs that only one of them has."""
    odd = np.bincount(text * BITS + (run % np.uint64(BITS)).astype(np.int64), minlength=n * BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(n, BITS // 64)


def bags(texts: DataFrame, text: str) -> DataFrame:
    """(_content, runs, weights, odd) of rows with ``_content``; runs are sorted."""

    def make():
        def work(texts):
            _, _, _, h, first = hash_batch(texts)
            doc, run, weight = shingles(h, first)
            ends = pa.array(np.searchsorted(doc, np.arange(len(texts) + 1)), pa.int32())
            steps = pa.array(np.arange(len(texts) + 1) * (BITS // 64), pa.int32())
            return [
                pa.ListArray.from_arrays(ends, pa.array(run.view(np.int64))),
                pa.ListArray.from_arrays(ends, pa.array(weight.astype(np.int32))),
                pa.ListArray.from_arrays(steps, pa.array(parities(doc, run, len(texts)).ravel())),
            ]

        return work

    adds = T.StructType(
        [
            T.StructField("runs", T.ArrayType(T.LongType())),
            T.StructField("weights", T.ArrayType(T.IntegerType())),
            T.StructField("odd", T.ArrayType(T.LongType())),
        ]
    )
    return map_rows(texts, [text], ["_content"], adds, make)


def may_be_near(a: str, b: str, threshold: float) -> Column:
    """Whether the parities of two bags (structs with ``odd`` and ``total``) allow the threshold.

    With p and q the shares of the weight that only the one and only the other bag has, J is at most
    (1-p)(1-q)/(1-pq), so p+q is at most 2(1-t)/(1+t), and the runs that one bag has alone are at most that times
    the larger total weight. No pair at or above the threshold fails the test.
    """
    bits = sum(
        (F.bit_count(F.col(f"{a}.odd")[i].bitwiseXOR(F.col(f"{b}.odd")[i])) for i in range(1, BITS // 64)),
        F.bit_count(F.col(f"{a}.odd")[0].bitwiseXOR(F.col(f"{b}.odd")[0])),
    )
    most = F.greatest(f"{a}.total", f"{b}.total") * (2 * (1 - threshold) / (1 + threshold))
    return bits <= most + 1e-6


def verified(pairs: DataFrame, bag: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose bags are similar enough, exactly computed."""
    left, right = (bag.select(F.col("_content").alias(s), F.col("runs").alias(f"r{s}"), F.col("weights").alias(f"w{s}")) for s in "ab")

    def make():
        def one(ra, wa, rb, wb):
            a, b = np.array(ra, np.int64).view(np.uint64), np.array(rb, np.int64).view(np.uint64)
            return similarity(a, np.array(wa), b, np.array(wb)) >= threshold

        return lambda ra, wa, rb, wb: [pa.array(list(map(one, ra, wa, rb, wb)), pa.bool_())]

    joined = pairs.join(left, "a").join(right, "b")
    adds = T.StructType([T.StructField("near", T.BooleanType())])
    return map_rows(joined, ["ra", "wa", "rb", "wb"], ["a", "b"], adds, make).where("near").select("a", "b")


def shared_bands(classes: DataFrame, folder: str, name: str) -> DataFrame:
    """(band, _content) of the bands with several classes; other columns of ``classes`` stay."""
    each = classes.select(*[c for c in classes.columns if c != "_bands"], F.explode("_bands").alias("band"))
    full = each.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band")
    return each.join(cut(full, folder, name), "band")


def decide(docs: DataFrame, key: str = "doc_id", text: str = "text", keeps: list[str] | None = None,
           threshold: float = THRESHOLD, names: tuple[str, str] = ("component_id", "kept")) -> DataFrame:
    """As ``_decide``, whatever the columns of ``docs`` are called; they travel under other names."""
    plain = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    keeps = list(dict.fromkeys([key, *(keeps or [])]))
    out = _decide(docs.toDF(*plain.values()), plain[key], plain[text], [plain[c] for c in keeps], threshold, names)
    return out.toDF(*keeps, *names)


def _decide(docs: DataFrame, key: str, text: str, keeps: list[str], threshold: float, names: tuple[str, str]) -> DataFrame:
    """Every row of ``docs`` (columns ``key`` and ``keeps``) with ``component_id``, the smallest ``key`` of the
    documents it is linked to directly or through others, and ``kept``, true for one row of each such group: the one
    with the smallest key, and the first of several rows with that key."""
    folder = work_folder(docs.sparkSession)
    rows = cut(prints(docs, text, keeps), folder, "prints")
    best = F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("_row").alias("row"))).alias("best")
    worded = rows.where(F.col("_content").isNotNull())
    classes = cut(worded.groupBy("_content").agg(best, F.first("_bands").alias("_bands")), folder, "classes")
    edges = links(classes, docs if text not in keeps else rows, key, text, threshold, folder)
    roots = components(edges, folder) if edges is not None else None
    decided = classes.select("_content", "best")
    if roots is not None:
        named = decided.join(roots, decided["_content"] == roots["node"], "left")
        named = named.select("_content", F.coalesce("root", "_content").alias("root"), "best")
        tops = cut(named.groupBy("root").agg(F.min("best").alias("top")), folder, "tops")
        decided = named.join(tops, "root").select("_content", F.col("top").alias("best"))
    decided = decided.select(F.col("_content").alias("_c"), F.col("best.key").alias("_key"), F.col("best.row").alias("_top"))
    out = rows.join(decided, rows["_content"] == decided["_c"], "left")
    alone = F.col("_content").isNull()
    made = (F.when(alone, F.col(key)).otherwise(F.col("_key")), alone | (F.col("_row") == F.col("_top")))
    return out.select(*keeps, *[x.alias(n) for x, n in zip(made, names)])


def links(classes: DataFrame, docs: DataFrame, key: str, text: str, threshold: float, folder: str) -> DataFrame | None:
    """Edges (a, b) between classes that join all classes of a group of near copies; None without candidates."""
    met = cut(shared_bands(classes.select("_content", "_bands"), folder, "full").select("_content").distinct(), folder, "met")
    if met.isEmpty():
        return None
    # texts of the candidates: by key first, then by what they say
    wanted = classes.join(met, "_content").select("_content", F.col("best.key").alias("_k"), F.col("best.row").alias("_row"))
    if "_content" in docs.columns:
        texts = docs.select("_row", text).join(wanted.select("_row", "_content"), "_row")
    else:
        keys = wanted.select("_k").distinct()
        near = docs.select(key, text).join(keys, docs[key].eqNullSafe(keys["_k"]), "left_semi")
        texts = prints_only(near, text).join(met, "_content", "left_semi").groupBy("_content").agg(F.first(text).alias(text))
    bag = cut(bags(texts, text), folder, "bags")
    each = bag.select("_content", F.explode(F.arrays_zip("runs", "weights")).alias("x"))
    each = each.select("_content", F.col("x.runs").alias("run"), F.col("x.weights").cast("double").alias("w"))
    often = each.groupBy("run").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    total = F.aggregate("weights", F.lit(0.0), lambda s, w: s + w)
    shared = each.join(often, "run").groupBy("_content").agg(
        F.sum("w").alias("common"), F.sum(F.col("w") * F.log("n")).alias("typical")
    )
    sized = bag.select("_content", total.alias("total"), "odd").join(shared, "_content")
    able = sized.where(F.col("common") >= F.lit(threshold - 1e-9) * F.col("total"))
    look = F.struct("_content", "odd", "total").alias("own")
    able = cut(able.select("_content", (F.col("typical") / F.col("total")).alias("typical"), look), folder, "able")
    members = cut(shared_bands(classes.select("_content", "_bands").join(able, "_content"), folder, "full-able"), folder, "members")
    heads = members.groupBy("band").agg(F.max(F.struct("typical", "own._content", "own")).alias("head"))
    heads = cut(heads.select("band", F.col("head.own").alias("head")), folder, "heads")
    pairs = members.join(heads, "band").where(may_be_near("own", "head", threshold))
    pairs = pairs.select(F.least("_content", "head._content").alias("a"), F.greatest("_content", "head._content").alias("b"))
    pairs = cut(pairs.where("a < b").distinct(), folder, "pairs")
    first = cut(verified(pairs, bag, threshold), folder, "edges")
    # what is still apart and shares a band
    roots = components(first, folder, "joined")
    placed = members.join(roots, members["_content"] == roots["node"], "left")
    placed = placed.select("band", "own", F.coalesce("root", "_content").alias("root"))
    split = placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("band")
    placed = cut(placed.join(cut(split, folder, "split"), "band"), folder, "apart")
    other = placed.select("band", F.col("own").alias("other"), F.col("root").alias("other_root"))
    rest = placed.join(other, "band").where("own._content < other._content and root <> other_root")
    rest = rest.where(may_be_near("own", "other", threshold))
    rest = rest.select(F.col("own._content").alias("a"), F.col("other._content").alias("b")).distinct()
    rest = cut(rest.join(pairs, ["a", "b"], "left_anti"), folder, "rest")
    return first.unionByName(cut(verified(rest, bag, threshold), folder, "more"))


def prints_only(docs: DataFrame, text: str) -> DataFrame:
    """``text`` with the digest of its word sequence."""

    def make():
        def work(texts):
            _, _, _, h, first = hash_batch(texts)
            blob, cuts = h.tobytes(), (first * 8).tolist()
            return [pa.array([hashlib.blake2b(blob[a:b], digest_size=16).digest() if b > a else None for a, b in zip(cuts, cuts[1:])], pa.binary())]

        return work

    return map_rows(docs, [text], [text], T.StructType([T.StructField("_content", T.BinaryType())]), make)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each group of near copies; columns unchanged."""
    names = fresh(docs, "_component"), fresh(docs, "_kept")
    return decide(docs, key, text, docs.columns, threshold, names).where(F.col(names[1])).select(*docs.columns)
