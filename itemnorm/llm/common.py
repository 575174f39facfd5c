"""What the operators share: tables, batches of rows in Python tasks, words as numbers, running numbers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itemnorm.session import cut, work_folder  # noqa: F401


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not use."""
    taken = {c.lower() for c in df.columns}
    name, n = stem, 0
    while name in taken:
        n += 1
        name = f"{stem}_{n}"
    return name


def remove(spark: SparkSession, path: str) -> None:
    """Delete a work table that no later step reads."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


# ---------------------------------------------------------------- rows in Python tasks


def map_rows(
    df: DataFrame, reads: list[str], keeps: list[str], adds: T.StructType, make: Callable[[], Callable]
) -> DataFrame:
    """``keeps`` columns unchanged plus ``adds`` columns computed from ``reads`` in Arrow batches.

    ``make()`` runs once per task and returns a function from lists of values (one per column of
    ``reads``) to Arrow arrays (one per column of ``adds``). Batches are cut so that the read texts of a
    call stay near 4 MB, whatever the length of single rows.
    """
    out = T.StructType([df.schema[c] for c in keeps] + list(adds))
    wanted = list(dict.fromkeys([*keeps, *reads]))
    spots = {c: i for i, c in enumerate(wanted)}
    kept, read_at = [spots[c] for c in keeps], [spots[c] for c in reads]
    names = [f.name for f in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in _parts(batch, read_at):
                made = work(*[part.column(i).to_pylist() for i in read_at])
                yield pa.RecordBatch.from_arrays([part.column(i) for i in kept] + list(made), names=names)

    return df.select(*wanted).mapInArrow(run, out)


def _parts(batch: pa.RecordBatch, columns: list[int], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    if batch.num_rows == 0:
        return
    size = np.zeros(batch.num_rows, np.int64)
    for i in columns:
        if pa.types.is_string(batch.column(i).type) or pa.types.is_large_string(batch.column(i).type):
            lengths = pc.binary_length(batch.column(i)).fill_null(0)
            size += np.asarray(lengths.to_numpy(zero_copy_only=False), np.int64)
    group = np.cumsum(size) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


# ---------------------------------------------------------------- words as 64-bit numbers

M64 = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_IS_WORD = _IS_WORD[_LOWER]
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * GOLDEN)[_LOWER]
_BASE = 0x5851F42D4C957F2D
PIECE = 1 << 18
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64."""
    size = 1 << max(n, PIECE).bit_length()
    if size not in _POWERS:
        _POWERS.clear()
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[size]


def _hash_piece(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    word = _IS_WORD[buf]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if word[0]:
        edge = np.concatenate([[0], edge])
    if word[-1]:
        edge = np.concatenate([edge, [buf.size]])
    start, end = edge[0::2], edge[1::2]
    up, down = _powers(buf.size)
    run = np.zeros(buf.size + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[: buf.size], out=run[1:])
    return start, end, mix((run[end] - run[start]) * down[start])


def hash_starts(text: bytes, start: np.ndarray, end: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which words have more than ``n`` bytes, and the hash of those words' first ``n`` bytes."""
    buf = np.frombuffer(text, np.uint8)
    more = end - start > n
    start = start[more]
    up, _ = _powers(n)
    value = np.zeros(start.size, np.uint64)
    for k in range(n):
        value += _BYTE[buf[start + k]] * up[k]
    return more, mix(value + np.uint64(n))


def hash_words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start, byte end and hash of each word ``[0-9a-z\\x80-\\xff]+`` of a UTF-8 text, A-Z lower-cased.

    The text is taken in pieces that end between words, so memory beyond the result does not grow with it.
    """
    buf = np.frombuffer(text, np.uint8)
    if buf.size <= PIECE:
        return _hash_piece(buf) if buf.size else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    found, at = [], 0
    while at < buf.size:
        end = at + PIECE
        while end < buf.size and _IS_WORD[buf[end]] and _IS_WORD[buf[end - 1]]:
            end += 1
        start, stop, h = _hash_piece(buf[at:end])
        found.append((start + at, stop + at, h))
        at = end
    return tuple(np.concatenate(x) for x in zip(*found))


def hash_batch(texts: list[str | None]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts joined by a blank, then start, end and hash of their words, and the first word of each text
    (one more entry than texts)."""
    blobs = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    joined = b" ".join(blobs)
    start, end, h = hash_words(joined)
    size = np.fromiter((len(b) + 1 for b in blobs), np.int64, len(blobs))
    first = np.concatenate([[0], np.searchsorted(start, np.cumsum(size))])
    return joined, start, end, h, first


# ---------------------------------------------------------------- running numbers


def number_within(df: DataFrame, group: Column, order: list[Column], name: str, salts: int) -> DataFrame:
    """``df`` plus ``name``: gapless numbers from 0 within each value of ``group``.

    Rows of a group are dealt into ``salts`` buckets by the hash of ``order``; a window numbers each bucket and
    the buckets' sizes shift it. No task sees a whole group. Order within a group is by bucket, then ``order``;
    rows alike in ``order`` are numbered arbitrarily. A column ``name`` is replaced.
    """
    df = df.drop(name)
    g, s, n, base = (fresh(df, x) for x in ("_group", "_salt", "_size", "_base"))
    salted = df.withColumn(g, group).withColumn(s, F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    before = Window.partitionBy(g).orderBy(s).rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        salted.groupBy(g, s)
        .agg(F.count(F.lit(1)).alias(n))
        .withColumn(base, F.coalesce(F.sum(n).over(before), F.lit(0)))
        .drop(n)
    )
    within = F.row_number().over(Window.partitionBy(g, s).orderBy(*order))
    left = salted.withColumn(name, within)
    joined = left.join(sizes, left[g].eqNullSafe(sizes[g]) & (left[s] == sizes[s]), "left")
    return joined.select(
        *[left[c] for c in df.columns], (left[name] - 1 + F.coalesce(sizes[base], F.lit(0))).cast("long").alias(name)
    )
