"""Near-duplicate embeddings: codes by iterative quantisation, multi-index Hamming tables, exact reranking.

A rotation of the principal components is learned so that the signs of the rotated vectors lie close to the vectors
themselves (alternating between the signs and the best rotation for them). It is fitted on at most ``SAMPLE``
vectors; every vector gets a code and is searched for. Codes are cut into 16-bit parts, once from bit 0 and once from
bit 8, and two vectors meet if some part differs in at most one bit; pairs whose codes are close enough are compared
by their rounded vectors, which tell an upper bound, and what may be near by cosine in double precision.

Dense places: a part value with more than ``HOT`` vectors gets the mean direction of its vectors as a centre (taken
again over the vectors around it). Vectors within half the linking angle of one centre are a cell, and all of a
cell's vectors are linked with each other by the triangle inequality, so a large group of near copies is counted and
joined without forming its pairs. Only pairs that are not in one cell are searched and compared.

No join sends a table to all tasks: each side of a join grows with the input, and Spark, which goes by the size of a
table's compressed file, counts neither the rows that an explode adds nor what they take in memory.

Null and zero vectors and those with null or non-finite components link with nothing. Vectors of different lengths do
not link. Equal ids are separate rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, remove, work_folder
from .groups import components, shuffled

COSINE = 0.9
SAMPLE = 8_000
BITS = 64
PART = 16
TURNS = 40
#: Codes of a pair may differ in this share of their bits; vectors at the linking angle differ in 0.14 on average.
FAR = 0.32
HOT = 48


def learn(x: np.ndarray, bits: int = BITS, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (principal components times rotation) of unit vectors. As many bits as dimensions at
    most."""
    mean = x.mean(0) if len(x) else np.zeros(x.shape[1])
    values, vectors = np.linalg.eigh((x - mean).T @ (x - mean))
    w = vectors[:, ::-1][:, :bits]
    v = (x - mean) @ w
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(w.shape[1], w.shape[1])))[0]
    for _ in range(TURNS if len(x) else 0):
        signs = np.where(v @ r >= 0, 1.0, -1.0)
        a, _, b = np.linalg.svd(v.T @ signs)
        r = a @ b
    return mean, w @ r


def codes(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    bits = ((x - mean) @ projection >= 0).astype(np.uint8)
    bits = np.pad(bits, ((0, 0), (0, BITS - bits.shape[1])))
    return np.packbits(bits, axis=1).view(">i8").astype(np.int64).ravel()


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column whose lists have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unit_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length 1, and which rows can be. Scaled by the largest component first, so none overflows."""
    with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
        top = np.abs(x).max(1, initial=0.0)
        y = x / top[:, None]
        y = y / np.sqrt((y * y).sum(1))[:, None]
    ok = np.isfinite(top) & (top > 0) & np.isfinite(y).all(1)
    return np.where(ok[:, None], y, 0.0), ok


def units(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``key``, ``v`` (the vector scaled to length 1, null if it has none), ``dim``, and a row number."""
    out = T.StructType(
        [vectors.schema[key], T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("dim", T.IntegerType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            size = np.asarray(pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            made: list = [None] * batch.num_rows
            for d in np.unique(size[size > 0]).tolist():
                at = np.flatnonzero(size == d)
                flat = column.take(pa.array(at)).flatten()
                x = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(at), d)
                y, ok = unit_rows(x)
                for i, row, good in zip(at.tolist(), y, ok.tolist()):
                    made[i] = row if good else None
            lists = pa.array(made, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(size, pa.int32())], names=[f.name for f in out])

    return vectors.select(key, vector).mapInArrow(run, out).withColumn("row", F.monotonically_increasing_id())


def coded(rows: DataFrame, models: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(row, dim, code) of the rows that have a vector."""
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for d in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == d))
                code = codes(matrix(part.column(2)), *shared.value[d])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(code)], names=["row", "dim", "code"])

    return rows.where(F.col("v").isNotNull()).select("row", "dim", "v").mapInArrow(run, "row long, dim int, code long")


def part_values(code: str, n: int = BITS // PART) -> list:
    """The 16-bit parts of a code from bit 0 and, in a circle, from bit 8."""
    c = F.col(code)
    turned = F.shiftleft(c, PART // 2).bitwiseOR(F.shiftrightunsigned(c, BITS - PART // 2))
    mask = F.lit((1 << PART) - 1)
    return [F.shiftrightunsigned(x, PART * i).bitwiseAND(mask) for x in (c, turned) for i in range(n)]


def stored(rows: DataFrame, code: str = "code") -> DataFrame:
    """``rows`` once per part, with its number ``t`` and value ``k``."""
    return rows.select("*", F.posexplode(F.array(*part_values(code))).alias("t", "k"))


def probed(rows: DataFrame) -> DataFrame:
    """``rows`` once per part and value within one bit."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(PART)])
    return stored(rows).withColumn("flip", F.explode(flips)).withColumn("k", F.col("k").bitwiseXOR(F.col("flip"))).drop("flip")


def cosines(pairs: DataFrame, keeps: list[str], name: str = "cosine") -> DataFrame:
    """``keeps`` and the inner product of the double arrays ``x`` and ``y``."""
    out = T.StructType([pairs.schema[c] for c in keeps] + [T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.list_value_length(batch.column(0)).to_numpy(zero_copy_only=False)
            value = np.zeros(batch.num_rows)
            for d in np.unique(size).tolist():
                at = pa.array(np.flatnonzero(size == d))
                value[at.to_numpy()] = (matrix(batch.column(0).take(at)) * matrix(batch.column(1).take(at))).sum(1)
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(value)], names=[f.name for f in out])

    return pairs.select("x", "y", *keeps).mapInArrow(run, out)


def rounded(rows: DataFrame) -> DataFrame:
    """``row``, ``q``: the vector in steps of 1/127, a byte a component, and ``r``: the length, in steps, of what rounding changed."""
    steps = rows.select("row", F.transform("v", lambda x: x * 127).alias("s"))
    left = F.transform("s", lambda x: x - F.rint(x))
    return steps.select(
        "row", F.transform("s", lambda x: F.rint(x).cast("tinyint")).alias("q"),
        F.sqrt(F.aggregate(left, F.lit(0.0), lambda a, x: a + x * x)).alias("r"),
    )


def with_vectors(pairs: DataFrame, rows: DataFrame, vector: str, *others: str) -> DataFrame:
    """``pairs`` (a, b) with the ``vector`` of a as ``x`` and of b as ``y``, and the columns ``others`` with ``_a`` and ``_b``."""
    left, right = (
        shuffled(rows.select(F.col("row").alias(s), F.col(vector).alias(x), *(F.col(c).alias(f"{c}_{s}") for c in others)))
        for s, x in (("a", "x"), ("b", "y"))
    )
    return shuffled(shuffled(pairs).join(left, "a")).join(right, "b")


def possible(pairs: DataFrame, short: DataFrame, cosine: float) -> DataFrame:
    """The pairs that may reach ``cosine`` by their rounded vectors (``short``, from :func:`rounded`).

    With x = q + e and y = p + f, the product xy is at most qp + |q||f| + |e||p| + |e||f|, and |q| is at most 127 + |e|.
    So no pair is lost, and only the others' vectors, eight times as long, are sent and compared."""
    e, f = F.col("r_a"), F.col("r_b")
    most = F.col("product") + (e + 127) * f + e * (f + 127) + e * f
    products = cosines(with_vectors(pairs, short, "q", "r"), ["a", "b", "r_a", "r_b"], "product")
    return products.where(most >= cosine * 127 * 127 - 1e-3).select("a", "b")


def cells(rows: DataFrame, code: DataFrame, cosine: float, folder: str) -> DataFrame | None:
    """(row, cell) of the vectors that lie within half the linking angle of a dense place's centre; a vector is in
    the fullest such cell. None without dense places."""
    places = stored(code)
    hot = places.groupBy("dim", "t", "k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT)
    hot = cut(hot.select("dim", "t", "k"), folder, "hot")
    if hot.isEmpty():
        return None
    crowd = places.join(shuffled(hot), ["dim", "t", "k"]).select("row", F.struct("dim", "t", "k").alias("cell"))
    crowd = cut(shuffled(crowd).join(shuffled(rows.select("row", "v")), "row"), folder, "crowd")
    around = crowd
    half = float(np.cos(np.arccos(cosine) / 2)) + 1e-7
    for turn, near in enumerate((0.5, 0.8, half)):
        each = around.select("cell", F.posexplode("v").alias("i", "x"))
        mean = each.groupBy("cell", "i").agg(F.sum("x").alias("x"))
        listed = F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"])  # one per dimension
        center = mean.groupBy("cell").agg(listed.alias("c"))
        length = F.sqrt(F.aggregate("c", F.lit(0.0), lambda a, x: a + x * x))
        center = center.withColumn("length", length).where("length > 0")
        center = cut(center.select("cell", F.transform("c", lambda x: x / F.col("length")).alias("y")), folder, f"centers-{turn}")
        near_rows = cosines(crowd.withColumnRenamed("v", "x").join(shuffled(center), "cell"), ["row", "cell"]).where(F.col("cosine") >= near)
        near_rows = cut(near_rows.select("row", "cell"), folder, f"around-{turn}")
        if turn < 2:
            around = shuffled(near_rows).join(shuffled(crowd), ["row", "cell"])
    sizes = cut(near_rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), folder, "cell-sizes")
    best = near_rows.join(shuffled(sizes), "cell").groupBy("row").agg(F.max(F.struct("n", "cell")).alias("best"))
    return cut(best.select("row", F.col("best.cell").alias("cell")), folder, "cells")


def near_groups(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """One row per vector: ``key``, ``n_links``, ``component_id`` and ``kept`` (its key is the component's)."""
    spark, folder = vectors.sparkSession, work_folder(vectors.sparkSession)
    rows = cut(units(vectors, key, vector), folder, "units")
    good = rows.where(F.col("v").isNotNull())
    models = {}
    for d in [r.dim for r in good.select("dim").distinct().collect()]:
        some = good.where(F.col("dim") == d).orderBy(F.xxhash64("row")).limit(SAMPLE).select("v").toPandas()
        models[d] = learn(np.stack(some["v"].to_numpy()))
    code = cut(coded(rows, models), folder, "codes")
    cell = cells(rows, code, cosine, folder)
    none = F.lit(None).cast("struct<dim:int,t:int,k:bigint>")
    placed = code.withColumn("cell", none) if cell is None else code.join(shuffled(cell), "row", "left")
    placed = cut(placed, folder, "placed")
    a = probed(placed).select("dim", "t", "k", F.col("row").alias("a"), F.col("code").alias("ca"), F.col("cell").alias("la"))
    b = stored(placed).select("dim", "t", "k", F.col("row").alias("b"), F.col("code").alias("cb"), F.col("cell").alias("lb"))
    apart = F.col("la").isNull() | F.col("lb").isNull() | (F.col("la") != F.col("lb"))
    most = F.ceil(F.least(F.lit(BITS), F.col("dim")) * FAR)
    met = shuffled(a).join(shuffled(b), ["dim", "t", "k"]).where((F.col("a") < F.col("b")) & apart)
    met = met.where(F.bit_count(F.col("ca").bitwiseXOR(F.col("cb"))) <= most)
    met = cut(met.select("a", "b").distinct(), folder, "met")
    close = cut(possible(met, cut(rounded(good), folder, "rounded"), cosine), folder, "close")
    for done in ("placed", "met", "rounded"):
        remove(spark, f"{folder}/{done}")
    found = cosines(with_vectors(close, good, "v"), ["a", "b"]).where(F.col("cosine") >= cosine)
    found = cut(found.select("a", "b"), folder, "links")
    counts = found.select(F.col("a").alias("r")).unionAll(found.select("b")).groupBy("r").agg(F.count(F.lit(1)).alias("n"))
    edges = found
    if cell is not None:
        sizes = cut(cell.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("head")), folder, "heads")
        inside = cell.join(shuffled(sizes), "cell").select("row", "n", "head")
        counts = counts.unionAll(inside.select("row", F.col("n") - 1)).groupBy("r").agg(F.sum("n").alias("n"))
        edges = edges.unionAll(inside.where("row <> head").select("row", "head"))
    roots = components(edges, folder)
    joined = rows.select("row", key).join(shuffled(counts.withColumnRenamed("r", "row")), "row", "left")
    joined = joined.join(shuffled(roots.withColumnRenamed("node", "row")), "row", "left")
    joined = joined.withColumn("root", F.coalesce("root", "row"))
    least = cut(joined.groupBy("root").agg(F.min(key).alias("component_id")), folder, "least")
    return joined.join(shuffled(least), "root").select(
        F.col(key),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.col("component_id").cast("long"),
        F.col(key).eqNullSafe(F.col("component_id")).alias("kept"),
    )
