"""Toxicity scores by a factorization machine over hashed terms.

Terms are the distinct lower-cased words of the whole text and the beginnings of its longer words (inflected forms
share them), hashed into ``2**BITS`` columns. The machine scores
    w0 + sum_i w_i + sum_{i<j} <v_i, v_j>   over the columns present,
so that pairs of terms count beyond what each adds alone; the pair sum costs one pass over the terms through
((sum v)^2 - sum v^2) / 2. A column has parameters only if it occurs in at least ``MIN_ROWS`` training rows and its presence depends on the
label (likelihood ratio of at least ``MIN_GAIN``). Other columns add nothing, so the thousands of neutral words of
a long text do not drown a few strong ones.

It is fitted by AdaGrad with L2 shrinkage on at most ``TRAIN_ROWS`` labelled rows, taken in the order of the hash
of their ids. That bound is the only one: every text is scored whole, with the same parameters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh, hash_batch, hash_starts, map_rows, remove, work_folder

BITS = 18
RANK = 4
BEGINNINGS = (4, 5, 6, 7, 8)
TRAIN_ROWS = 20_000
MIN_ROWS = 3
MIN_GAIN = 15.0
EPOCHS = 30
RATE, SHRINK, BATCH = 0.1, 1e-4, 64


def terms(texts: list[str | None], spot: np.ndarray | None = None) -> list[np.ndarray]:
    """Sorted distinct columns of each text: its words and their beginnings. With ``spot``, only the columns that
    have parameters, as their rows in the parameters."""
    joined, start, end, h, first = hash_batch(texts)
    down = np.uint64(64 - BITS)
    text = np.repeat(np.arange(len(texts), dtype=np.int64) << BITS, np.diff(first))
    found = []

    def add(text, hashes):
        columns = (hashes >> down).astype(np.int64)
        if spot is not None:
            columns = spot[columns]
            text, columns = text[columns >= 0], columns[columns >= 0]
        found.append(text | columns)

    add(text, h)
    for n in BEGINNINGS:
        more, b = hash_starts(joined, start, end, n)
        add(text[more], b)
    both = np.unique(np.concatenate(found))
    ends = np.searchsorted(both, np.arange(len(texts) + 1, dtype=np.int64) << BITS).tolist()
    columns = (both & ((1 << BITS) - 1)).astype(np.int32)
    return [columns[a:b] for a, b in zip(ends, ends[1:])]


def gain(seen: np.ndarray, marked: np.ndarray, n: int, n_marked: int) -> np.ndarray:
    """Likelihood ratio between a column's presence (``seen`` rows, ``marked`` of them with label 1) and the label."""
    seen, marked, n, t = seen.astype(float), marked.astype(float), float(n), float(n_marked)
    g = np.zeros(seen.size)
    for count, share in (
        (marked, seen * t),
        (seen - marked, seen * (n - t)),
        (t - marked, (n - seen) * t),
        (n - t - seen + marked, (n - seen) * (n - t)),
    ):
        some = (count > 0) & (share > 0)
        g[some] += 2 * count[some] * np.log(count[some] * n / share[some])
    return g


def places(columns: np.ndarray, seen: np.ndarray, marked: np.ndarray, n: int, n_marked: int) -> np.ndarray:
    """The row of parameters of each column, -1 for columns without."""
    live = np.sort(columns[(seen >= MIN_ROWS) & (gain(seen, marked, n, n_marked) >= MIN_GAIN)])
    spot = np.full(1 << BITS, -1, np.int32)
    spot[live] = np.arange(live.size)
    return spot


class Machine:
    """Parameters of the fitted machine. ``spot`` maps a column to its row of parameters, or to -1."""

    def __init__(self, spot: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray):
        self.spot, self.bias, self.w, self.v = spot, bias, w, v

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(rows), self.bias)
        full = [i for i, x in enumerate(rows) if x.size]
        if full:
            at = np.cumsum([0] + [rows[i].size for i in full[:-1]])
            flat = np.concatenate([rows[i] for i in full])
            v = self.v[flat]
            s, q = np.add.reduceat(v, at), np.add.reduceat((v * v).sum(1), at)
            out[full] += np.add.reduceat(self.w[flat], at) + 0.5 * ((s * s).sum(1) - q)
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(terms(texts, self.spot)), -30, 30)))


def fit_rows(own: list[np.ndarray], y: np.ndarray, spot: np.ndarray, seed: int = 7) -> Machine:
    """Fit on rows of parameter rows and 0/1 labels. Without both labels the score is the smoothed share of label 1,
    and without any label it is below 0.5."""
    rate = (y.sum() + 0.5) / (len(y) + 2)
    bias = float(np.log(rate / (1 - rate)))
    size = int(spot.max()) + 1
    rng = np.random.default_rng(seed)
    w, v = np.zeros(size), rng.normal(0, 0.01, (size, RANK))
    if len(y) == 0 or y.min() == y.max():
        return Machine(spot, bias, w, v * 0)
    gw, gv, gb = np.full(size, 1e-2), np.full((size, RANK), 1e-2), 1e-2
    for epoch in range(EPOCHS):
        order = rng.permutation(len(own))
        for a in range(0, len(order), BATCH):
            pick = [i for i in order[a : a + BATCH] if own[i].size]
            if not pick:
                continue
            at = np.cumsum([0] + [own[i].size for i in pick[:-1]])
            counts = [own[i].size for i in pick]
            flat = np.concatenate([own[i] for i in pick])
            vf = v[flat]
            s = np.add.reduceat(vf, at)
            q = np.add.reduceat((vf * vf).sum(1), at)
            z = bias + np.add.reduceat(w[flat], at) + 0.5 * ((s * s).sum(1) - q)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) / len(pick)
            each = np.repeat(g, counts)
            used, where = np.unique(flat, return_inverse=True)
            dw = np.bincount(where, each) + SHRINK * w[used]
            gw[used] += dw * dw
            w[used] -= RATE * dw / np.sqrt(gw[used])
            if epoch:
                pull = each[:, None] * (np.repeat(s, counts, axis=0) - vf)
                dv = np.stack([np.bincount(where, pull[:, k]) for k in range(RANK)], 1) + SHRINK * v[used]
                gv[used] += dv * dv
                v[used] -= 0.5 * RATE * dv / np.sqrt(gv[used])
            gb += g.sum() ** 2
            bias -= RATE * g.sum() / np.sqrt(gb)
    return Machine(spot, bias, w, v)


def held_out(key: Column) -> Column:
    """Whether labels of a row stay unseen in training: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Machine:
    """The machine of the labelled rows that are not held out; null labels, ids and texts without words do not
    teach. Only their columns with parameters reach the driver, of at most ``TRAIN_ROWS`` rows."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
    known = known.groupBy(key).agg(F.max(label).alias("_y"))
    chosen = known.orderBy(F.crc32(F.reverse(F.col(key).cast("string")).cast("binary")), key).limit(TRAIN_ROWS)
    rows = docs.select(key, text).where(F.col(text).isNotNull()).join(F.broadcast(chosen), key)  # TRAIN_ROWS at most

    def make():
        def work(texts):
            return [pa.array(terms(texts), pa.list_(pa.int32()))]

        return work

    adds = T.StructType([T.StructField("terms", T.ArrayType(T.IntegerType()))])
    folder = work_folder(docs.sparkSession)
    taught = cut(map_rows(rows, [text], [key, "_y"], adds, make).where(F.size("terms") > 0), folder, "taught")
    total = taught.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_y"), F.lit(0)).alias("t")).first()
    found = taught.select(F.explode("terms").alias("c"), "_y").groupBy("c")
    counts = found.agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("t")).where(F.col("n") >= MIN_ROWS).toPandas()
    spot = places(*(counts[x].to_numpy(np.int64) for x in ("c", "n", "t")), total.n, total.t)
    got = _live_rows(taught, key, spot)
    remove(docs.sparkSession, folder)
    return fit_rows([np.asarray(t, np.int32) for t in got["own"]], got["_y"].to_numpy(float), spot)


def _live_rows(taught: DataFrame, key: str, spot: np.ndarray):
    """The training rows, in the order of their keys, reduced to columns that have parameters."""
    shared = taught.sparkSession.sparkContext.broadcast(spot)

    def make():
        def work(rows):
            placed = (shared.value[np.asarray(r, np.int64)] for r in rows)
            return [pa.array([p[p >= 0] for p in placed], pa.list_(pa.int32()))]

        return work

    adds = T.StructType([T.StructField("own", T.ArrayType(T.IntegerType()))])
    return map_rows(taught, ["terms"], [key, "_y"], adds, make).toPandas().sort_values(key, kind="stable")


def score(docs: DataFrame, machine: Machine, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` plus the probability of the label as ``name``, in place of a column of that name; a null or empty text gets the score of no terms."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def make():
        return lambda texts: [pa.array(shared.value.score(texts), pa.float64())]

    docs = docs.drop(name)
    return map_rows(docs, [text], docs.columns, T.StructType([T.StructField(name, T.DoubleType())]), make)


def clean(docs: DataFrame, machine: Machine, text: str = "text", limit: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose score reaches ``limit``."""
    name = fresh(docs, "_score")
    return score(docs, machine, text, name).where(F.col(name) < limit).select(*docs.columns)
