"""The factorization machine: held-out accuracy, pair terms, odd tables."""

import random

import numpy as np
import pytest

from itemnorm.llm import queries
from itemnorm.llm import toxicity as X


def fitted(texts, y):
    rows = X.terms(texts)
    columns, n = np.unique(np.concatenate(rows), return_counts=True)
    t = np.array([sum(v for r, v in zip(rows, y) if c in set(r.tolist())) for c in columns])
    spot = X.places(columns, n, t, len(y), int(sum(y)))
    own = [s[s >= 0] for s in (spot[r] for r in rows)]
    return X.fit_rows(own, np.array(y, float), spot)


def test_pairs_count_beyond_words():
    rng = random.Random(2)
    filler = ["w%02d" % i for i in range(40)]
    rows = []
    for i in range(1600):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append((" ".join(rng.sample(filler, 5) + ["fools"] * a + ["group"] * b), int(a and b)))
    m = fitted([t for t, _ in rows[:1200]], [y for _, y in rows[:1200]])
    p = m.score([t for t, _ in rows[1200:]])
    assert np.mean((p >= 0.5) == np.array([y for _, y in rows[1200:]])) > 0.98
    assert np.abs(m.v).max() > 0.1


def test_long_text_is_read_to_its_end():
    m = fitted(["idiot clown here"] * 40 + ["good day all"] * 40, [1] * 40 + [0] * 40)
    long = "plain words " * 200_000
    assert m.score([long])[0] < 0.5 < m.score([long + " idiot"])[0]


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op1_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    wrong = got[got["predicted"] != got["toxic"]]
    assert len(got) > 700 and len(wrong) / len(got) < 0.04 and ((wrong["toxic"] == 0).sum()) <= 5


@pytest.mark.parametrize("labels", [[], [(1, None)], [(1, 0), (2, 0)]])
def test_few_labels(spark, labels):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (3, "a b"), (None, "x")], "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    m = X.fit(docs, known)
    out = X.score(docs.withColumn("score", docs.text), m).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert X.clean(docs.limit(0), m).count() == 0
