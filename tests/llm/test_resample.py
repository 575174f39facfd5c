"""Importance resampling against a plain computation."""

import math
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from itemnorm.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def plain_features(text, runs, buckets):
    words = WORD.findall((text or "").translate(UPPER))
    return [zlib.crc32(" ".join(words[i : i + r]).encode()) % buckets for r in range(1, runs + 1) for i in range(len(words) - r + 1)], len(words)


def plain(docs, target, percent, runs=1, buckets=10_000, least=20):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(plain_features(text, runs, buckets)[0])
    for text in target:
        t.update(plain_features(text, runs, buckets)[0])
    a, b = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda x: math.floor(1000 * math.log((t[x] + 1) * a / ((s[x] + 1) * b)))
    rows = []
    for key, text in docs:
        found, n = plain_features(text, runs, buckets)
        h = int(sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, found))
        rows.append([key, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0]))
    rank = {id(r): i + 1 for i, r in enumerate(able[: len(able) * percent // 100])}
    return [(*r, rank.get(id(r))) for r in rows]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=80), st.text("aB 9.éÿ中", max_size=300)), max_size=12), st.integers(1, 3))
def test_features(texts, runs):
    of, bucket, n_words = resample.features(texts, runs, 997)
    for i, text in enumerate(texts):
        want, n = plain_features(text, runs, 997)
        assert sorted(bucket[of == i].tolist()) == sorted(want) and n_words[i] == n


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-20_000, 20_000), min_size=1, max_size=200), st.data())
def test_planes_give_the_weighted_sum(gain, data):
    n = data.draw(st.integers(1, 150))
    found = data.draw(st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, len(gain) - 1)), max_size=400))
    found.sort()
    of, bucket = (np.array([f[i] for f in found], np.int64) for i in (0, 1))
    want = [sum(gain[b] for d, b in found if d == i) for i in range(n)]
    assert resample.Gains(np.array(gain, np.int64)).weights(of, bucket, n).tolist() == want


def test_long_words():
    texts = ["x" * n + " " + "é" * n for n in (1, 47, 48, 49, 500, 70_000)]
    of, bucket, _ = resample.features(texts)
    assert bucket.tolist() == [b for t in texts for b in plain_features(t, 1, 10_000)[0]]


@pytest.mark.parametrize("runs,percent", [(1, 10), (2, 50), (1, 100)])
def test_against_plain(spark, runs, percent):
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(60)] + ["Über", "ZEBRA", "9"]
    docs = [(i, " ".join(rng.choice(vocab, rng.integers(0, 60)))) for i in range(80)]
    docs += [(90, None), (91, ""), (92, "...!"), (None, "w1 " * 25), (95, "w2 " * 5000), (96, "w2 " * 5000)]
    target = [" ".join(rng.choice(vocab[:9], 30)) for _ in range(5)] + [None, ""]
    df = spark.createDataFrame([(k, t, "a", 1) for k, t in docs], "doc_id long, text string, weight string, rank int").repartition(5)
    goal = spark.createDataFrame([(t, "x") for t in target], "text string, score string")
    got = [tuple(r) for r in resample.resample(df, goal, percent, runs=runs).collect()]
    key = lambda r: (r[0] is not None, r[0])
    assert sorted(got, key=key) == sorted(plain(docs, target, percent, runs), key=key)


def test_repeated_rows_and_ties(spark):
    rows = [(1, "a " * 30)] * 4 + [(1, "b " * 30), (2, "a " * 30)]
    got = resample.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("a",)], "text string"), 50).collect()
    assert len(got) == 6 and sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3]


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string")
    assert resample.resample(none, one).count() == 0
    (row,) = resample.resample(one, none, 100).collect()
    assert tuple(row)[:4] == plain([(1, "a " * 30)], [], 100)[0][:4] and row["rank"] == 1
