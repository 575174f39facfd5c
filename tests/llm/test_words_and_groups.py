"""Shared parts: words as numbers, running numbers, components."""

import random

import numpy as np
from pyspark.sql import functions as F

from itemnorm.llm import common
from itemnorm.llm.common import hash_batch, hash_words, number_within, work_folder
from itemnorm.llm.groups import components


def test_words_do_not_depend_on_pieces(monkeypatch):
    text = ("Ab cD,éß 12" * 50 + " x" * 70 + "y" * 200).encode()
    start, end, h = hash_words(text)
    words = [text[a:b].lower() for a, b in zip(start, end)]
    assert words == [w for w in bytes(c if chr(c).isalnum() or c > 127 else 32 for c in text.lower()).split()]
    monkeypatch.setattr(common, "PIECE", 16)
    common._POWERS.clear()
    again = hash_words(text)
    common._POWERS.clear()
    assert all(np.array_equal(a, b) for a, b in zip((start, end, h), again))
    by_word = dict(zip(words, h.tolist()))
    assert len(set(by_word.values())) == len(by_word)


def test_batch_of_null_and_empty():
    _, start, _, _, first = hash_batch([None, "", "a b", " "])
    assert first.tolist() == [0, 0, 0, 2, 2] and len(start) == 2


def test_numbers_are_gapless(spark):
    rows = [(i % 3 if i % 7 else None, i // 2) for i in range(500)] + [(0, 1)] * 30
    df = spark.createDataFrame(rows, "g int, o int")
    out = number_within(df, F.col("g"), [F.col("o")], "n", 5).collect()
    by = {}
    for r in out:
        by.setdefault(r.g, []).append(r.n)
    assert len(out) == len(rows) and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_components_like_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(500, i) for i in range(501, 560)]
    edges += [(i, i + 1) for i in range(600, 640)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        parent[hi] = lo
    got = components(spark.createDataFrame(edges, "a int, b int"), work_folder(spark))
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert {r.node: r.root for r in got.collect()} == want
    assert components(spark.createDataFrame([], "a int, b int"), work_folder(spark)).count() == 0
