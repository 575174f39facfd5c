"""Language of texts by averaged hashed subword embeddings and a linear softmax.

A word, lower-cased and between two marks, gives itself and all its runs of 2 to 4 bytes, hashed into ``2**BITS`` rows
of an embedding table. A text is the mean of the embeddings of all its subwords, and a linear layer turns the mean into
one number per language. Both layers are fitted by stochastic gradient descent in numpy.

It learns from at most ``ROWS`` rows of a language, taken in the order of a hash of their keys, and from each of them
stretches of 2, 8 and 32 words, as short texts are the hard ones. Every fifth of these rows only calibrates: a
temperature makes the probabilities honest, and the threshold of rejection is the lowest one at which
at most ``ERROR`` of the accepted stretches were wrong. The number of languages is taken to be small, as the table of
a fitted classifier holds one number per subword and language.

Texts are scored whole. As mean and layer are both linear, the two tables are multiplied once and a text costs
one small row per subword, looked up once per different word of a batch.

Null texts and texts without a letter get ``UNKNOWN`` and score 0, as does every text if no row has a language. Equal
numbers go to the alphabetically first language. Rows whose key is null teach nothing; rows with the same key and
language teach once, by their smallest text. Columns of the result that the documents already have are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itemnorm.operators.ordering import first_per_group

from .common import GOLDEN, hash_batch, map_rows, mix

BITS = 16
SIZE = 16
RUNS = (2, 3, 4)
ROWS = 600
PARTS = 64
STRETCHES = (2, 8, 32)
STEPS, BATCH, RATE = 1500, 32, 16.0
ERROR = 0.01
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


def subwords(joined: bytes, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all subwords of the words, word after word, and the number of subwords of each word."""
    size = end - start + 2
    first = np.concatenate([[0], np.cumsum(size)])
    within = np.arange(first[-1]) - np.repeat(first[:-1], size)
    edge = (within == 0) | (within == np.repeat(size, size) - 1)
    source = np.repeat(start - 1, size) + within
    buf = np.frombuffer(joined, np.uint8)
    letter = np.where(edge, 1, buf[np.clip(source, 0, buf.size - 1)]).astype(np.uint64) if buf.size else np.zeros(0, np.uint64)
    left = np.repeat(size, size) - within  # bytes from here to the end of the word, marks included
    word = np.repeat(np.arange(size.size), size)
    rows, of = [(h >> np.uint64(64 - BITS)).astype(np.int32)], [np.arange(size.size)]
    run = letter.copy()
    for n in range(2, max(RUNS) + 1):
        run[: run.size - n + 1] = run[: run.size - n + 1] * np.uint64(257) + letter[n - 1 :]
        if n in RUNS:
            whole = left >= n
            rows.append((mix(run[whole] * GOLDEN + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int32))
            of.append(word[whole])
    rows, of = np.concatenate(rows), np.concatenate(of)
    return rows[np.argsort(of, kind="stable")], np.bincount(of, minlength=size.size)


def lowered(texts: list[str | None]) -> list[str]:
    return [(t or "").lower() for t in texts]


class Classifier:
    """Languages in alphabetical order, the product of both layers, offsets, temperature and threshold."""

    def __init__(self, languages: list[str], table: np.ndarray, offset: np.ndarray, temperature: float = 1.0, threshold: float = 0.0):
        self.languages, self.table, self.offset = languages, table, offset
        self.temperature, self.threshold = temperature, threshold

    def raw(self, texts: list[str | None]) -> np.ndarray:
        """One number per text and language."""
        joined, start, end, h, first = hash_batch(lowered(texts))
        out = np.tile(self.offset, (len(texts), 1))
        if not start.size:
            return out
        _, some, which = np.unique(h, return_index=True, return_inverse=True)
        rows, n = subwords(joined, start[some], end[some], h[some])
        worth = np.add.reduceat(self.table[rows], np.concatenate([[0], np.cumsum(n)[:-1]]))
        full = np.flatnonzero(np.diff(first))
        total = np.add.reduceat(worth[which], first[full])
        return_n = np.add.reduceat(n[which], first[full])
        out[full] += total / return_n[:, None]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, probability and whether it is too low to be relied upon."""
        known = np.array([bool(t) and LETTER.search(t) is not None for t in texts], bool)
        if not self.languages:
            known[:] = False
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), ~known
        p = softmax(self.raw(texts) / self.temperature)
        best = p.argmax(1) if len(texts) else np.zeros(0, int)
        score = np.where(known, p[np.arange(len(texts)), best], 0.0)
        named = [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
        return named, score, ~known | (score < self.threshold)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit_rows(rows: list[np.ndarray], y: np.ndarray, k: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The product of the embedding table and the linear layer, and the offsets, after ``STEPS`` steps of gradient
    descent with a falling rate. A batch's gradient is the mean over its texts."""
    rng = np.random.default_rng(seed)
    e = rng.uniform(-1 / SIZE, 1 / SIZE, (1 << BITS, SIZE))
    w, b = rng.normal(0, 1 / SIZE, (SIZE, k)), np.zeros(k)
    passes = -(-STEPS // -(-len(rows) // BATCH))
    steps, at = passes * -(-len(rows) // BATCH), 0
    for _ in range(passes):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), BATCH):
            rate, at = RATE * (1 - at / steps), at + 1
            pick = order[a : a + BATCH]
            n = np.array([rows[i].size for i in pick])
            flat = np.concatenate([rows[i] for i in pick])
            mean = np.add.reduceat(e[flat], np.concatenate([[0], np.cumsum(n)[:-1]])) / n[:, None]
            g = softmax(mean @ w + b)
            g[np.arange(len(pick)), y[pick]] -= 1
            g /= len(pick)
            back = (g @ w.T) / n[:, None]
            w -= rate * 0.1 * (mean.T @ g)
            b -= rate * 0.1 * g.sum(0)
            order_ = np.argsort(flat, kind="stable")
            sorted_ = flat[order_]
            heads = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
            e[sorted_[heads]] -= rate * np.add.reduceat(np.repeat(back, n, axis=0)[order_], heads)
    return e @ w, b


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The temperature of least log loss, and the lowest threshold whose accepted rows are wrong in at most ``ERROR``
    of cases."""
    if not len(y):
        return 1.0, 0.0
    row = np.arange(len(y))
    tried = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    loss = [-np.log(np.maximum(softmax(z / t)[row, y], 1e-12)).mean() for t in tried]
    temperature = float(tried[int(np.argmin(loss))])
    p = softmax(z / temperature)
    sure, wrong = p.max(1), p.argmax(1) != y
    order = np.argsort(-sure, kind="stable")
    share = (np.cumsum(wrong[order])) / (np.arange(len(y)) + 1)
    good = np.flatnonzero(share <= ERROR)
    return temperature, float(sure[order][good[-1]]) if good.size else 1.0


def held_out(key: Column) -> Column:
    """Whether a row stays unseen in training: crc32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def stretches(text: str | None, at: int) -> list[str]:
    """Stretches of a text, of so many words each, at places that ``at`` decides; texts too short give themselves once."""
    words = (text or "").split()
    found = []
    for i, n in enumerate(STRETCHES):
        if n >= len(words):
            found.append(" ".join(words))
            break
        place = (at * 2654435761 + i * 40503) % (1 << 32) * (len(words) - n + 1) >> 32
        found.append(" ".join(words[place : place + n]))
    return [t for t in found if LETTER.search(t)]


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang") -> Classifier:
    """The classifier of the documents that have a language and are not held out. At most ``ROWS`` rows of each
    language reach the driver, as the numbers of their stretches' subwords."""
    named = docs.select(F.col(key).alias("key"), F.col(language).alias("lang"), F.col(text).alias("text"))
    able = named.where(F.col("key").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("key")))
    place = F.crc32(F.reverse(F.col("key").cast("string")).cast("binary"))
    # in two steps, so that no task ranks the rows of a language that most documents have
    order, part = [F.col("at"), F.col("key")], F.pmod(F.xxhash64("key"), F.lit(PARTS))
    several = first_per_group(able.select("key", "lang", place.alias("at"), part.alias("part")), ["lang", "part"], order, ROWS)
    chosen = first_per_group(several.drop("rank"), ["lang"], order, ROWS).select("key", "lang", "at").distinct()
    rows = able.join(F.broadcast(chosen), ["key", "lang"])  # ROWS of each language at most
    rows = rows.groupBy("key", "lang", "at").agg(F.min("text").alias("text"))

    def make():
        def work(texts, at):
            each = [stretches(t, a) for t, a in zip(texts, at)]
            joined, start, end, h, first = hash_batch(lowered([s for e in each for s in e]))
            sub, n = subwords(joined, start, end, h)
            ends = np.concatenate([[0], np.cumsum(n)])[first]
            cut_ = iter([sub[a:b].tolist() for a, b in zip(ends, ends[1:])])
            return [pa.array([[next(cut_) for _ in e] for e in each], pa.list_(pa.list_(pa.int32())))]

        return work

    adds = T.StructType([T.StructField("subwords", T.ArrayType(T.ArrayType(T.IntegerType())))])
    got = map_rows(rows, ["text", "at"], ["key", "lang", "at"], adds, make).toPandas().sort_values(["at", "key", "lang"], kind="stable")
    languages = sorted(set(got["lang"]))
    number = {name: i for i, name in enumerate(languages)}
    taught, y, checked, yc = [], [], [], []
    for at, lang, each in zip(got["at"], got["lang"], got["subwords"]):
        for s in each:
            if len(s):
                rows_, labels = (checked, yc) if at % 5 == 0 else (taught, y)
                rows_.append(np.asarray(s, np.int32))
                labels.append(number[lang])
    if not taught:
        taught, y = checked, yc
    if not taught:
        return Classifier([], np.zeros((1 << BITS, 0)), np.zeros(0))
    table, offset = fit_rows(taught, np.array(y), len(languages))
    z = np.array([table[r].mean(0) for r in checked]).reshape(-1, len(languages)) + offset
    return Classifier(languages, table, offset, *calibrate(z, np.array(yc, int)))


def identify(docs: DataFrame, classifier: Classifier, text: str = "text", name: str = "lang_pred", score: str = "score", rejected: str = "rejected") -> DataFrame:
    """``docs`` plus the predicted language, its calibrated probability and whether that is below the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(classifier)

    def make():
        def work(texts):
            named, p, low = sent.value.predict(texts)
            return [pa.array(named, pa.string()), pa.array(p, pa.float64()), pa.array(low, pa.bool_())]

        return work

    adds = T.StructType([T.StructField(name, T.StringType()), T.StructField(score, T.DoubleType()), T.StructField(rejected, T.BooleanType())])
    if text in (name, score, rejected):
        raise ValueError("the text column cannot be a column of the result")
    kept = docs.drop(name, score, rejected)
    return map_rows(kept, [text], kept.columns, adds, make)
