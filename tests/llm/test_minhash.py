"""Weighted MinHash groups against brute force."""

import random
from collections import Counter

import numpy as np

from itemnorm.llm import weighted_minhash as W


def bag(text):
    _, _, _, h, first = W.hash_batch([text])
    _, run, weight = W.shingles(h, first)
    return run, weight


def plain_similarity(a, b):
    a, b = ({k: float(v) for k, v in zip(r.tolist(), w.tolist())} for r, w in (a, b))
    return sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in {*a, *b}) for d in a if d in b)


def brute(rows):
    parent = {i: i for i in range(len(rows))}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = [bag(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if bags[i][0].size and bags[j][0].size and plain_similarity(bags[i], bags[j]) >= W.THRESHOLD:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return [groups[find(i)] for i in range(len(rows))]


def texts(rng):
    vocabulary = ["w%d" % i for i in range(400)]
    rows, n = [], 0
    for size in (3, 5, 30, 60, 120, 200):
        base = [rng.choice(vocabulary) for _ in range(size)]
        for copies in range(14):
            words = list(base)
            for _ in range(rng.randint(0, 1 + size // 12)):
                words[rng.randrange(size)] = rng.choice(vocabulary)
            if copies % 5 == 0:
                words = words + words[: size // 2] * (copies % 3)
            rows.append((n, rng.choice([" ", ", "]).join(words)))
            n += 1
    return rows


def test_similarity_formula():
    rng = random.Random(4)
    for _ in range(60):
        a, b = (Counter(rng.choices(range(12), k=rng.randint(1, 30))) for _ in "ab")
        x, y = ((np.array(sorted(c), np.uint64), np.array([c[k] for k in sorted(c)])) for c in (a, b))
        assert abs(W.similarity(*x, *y) - plain_similarity(x, y)) < 1e-9


def test_signature_estimates_similarity():
    rng = random.Random(6)
    base = ["w%d" % rng.randrange(999) for _ in range(150)]
    other = list(base)
    for _ in range(6):
        other[rng.randrange(150)] = "new"
    _, _, _, h, first = W.hash_batch([" ".join(base * 2), " ".join(other), "one two"])
    made = W.signatures(*W.shingles(h, first), 3, 4000)
    assert abs((made[0] == made[1]).mean() - plain_similarity(bag(" ".join(base * 2)), bag(" ".join(other)))) < 0.03
    assert len(set(made[2].tolist())) == 1


def test_groups(spark):
    rows = texts(random.Random(8)) + [(900, None), (901, ""), (902, "!!"), (903, "w1 w2"), (904, "W1, w2.")]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, kept string").repartition(7)
    got = {r.doc_id: r for r in W.decide(df).collect()}
    want = brute(rows)
    for (i, _), group in zip(rows, want):
        assert got[i].component_id == min(group), i
        assert got[i].kept == (i == min(group))
    left = W.keep_one(df)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == {min(g) for g in want}


def test_dense_group_and_repeated_rows(spark):
    rng = random.Random(9)
    base = ["w%d" % rng.randrange(400) for _ in range(100)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(100)] = "e%d" % rng.randrange(1000)
        rows.append((i, " ".join(words)))
    same = [(7, "a b c d e f")] * 3 + [(None, "a b c d e f"), (None, "z y x w v u")]
    df = spark.createDataFrame(rows + same[3:] + [(1000 + k, t) for k, t in same[:3]], "doc_id long, text string")
    got = W.decide(df).collect()
    want = dict(zip([r[0] for r in rows], brute(rows)))
    assert all(r.component_id == min(want[r.doc_id]) for r in got if r.doc_id in want)
    tail = [r for r in got if r.doc_id not in want]
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in tail) == [
        (-1, -1, True), (-1, 1007, False), (1007, 1007, False), (1007, 1007, False), (1007, 1007, True)]
    assert W.decide(df.limit(0)).count() == 0
