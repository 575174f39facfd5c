"""Wu-Manber search against a plain search."""

import random
import re

from itemnorm.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out[d] = (len(w), len(hit), ",".join(sorted(found)))
    return out


def test_random_texts(spark, monkeypatch):
    rng = random.Random(3)
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(["a", "B", "cé", "dd", "1"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 3, 4, 9, 10, 11, 14]))) for i in range(12)] + [(99, None), (98, "a b"), (98, "A  B!")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)] + [(100, None), (101, ""), (102, items[6][1] + " " + text(700))]
    monkeypatch.setattr(D, "STRETCH", 16)
    b = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, found string")
    for blocks in (D.BATCH_WINDOWS, 7):
        monkeypatch.setattr(D, "BATCH_WINDOWS", blocks)
        out, found = D.occurrences(df, b)
        got = {r.doc_id: (r[found].n_words, sum(e - s for s, e in r[found]["spans"]), ",".join(r[found]["items"])) for r in out.collect()}
        assert got == brute(docs, items)
    kept = {r.doc_id for r in D.clean(df, b).collect()}
    assert kept == {d for d, x in brute(docs, items).items() if x[1] == 0}


def test_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    empty = spark.createDataFrame([], "item_id long, text string")
    assert D.report(docs, empty).first().contaminated is False
    assert D.report(docs.limit(0), empty).count() == 0
    assert D.clean(docs, empty).columns == docs.columns
