"""Language identification: accuracy on unseen rows, calibration, odd rows."""

import numpy as np
from pyspark.sql import functions as F

from itemnorm.llm import language

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = language.fit(docs)
    assert made.languages == ["de", "en", "es", "fr"]
    named = language.identify(docs.select("doc_id", "text", "lang"), made)
    unseen = named.where(language.held_out(F.col("doc_id"))).select("lang", "lang_pred", "score", "rejected").toPandas()
    assert len(unseen) > 200 and (unseen.lang == unseen.lang_pred).mean() > 0.98
    assert unseen.score.between(0, 1).all() and unseen.rejected.mean() < 0.05


def test_product_of_layers_and_word_cache():
    """Scores of a batch, looked up once per different word, against the mean over all subwords of a single text."""
    rng = np.random.default_rng(1)
    table, offset = rng.normal(size=(1 << language.BITS, 3)), np.array([0.1, 0.2, -0.3])
    made = language.Classifier(["a", "b", "c"], table, offset)
    texts = ["der Hund der Hund läuft", "", None, "x", "ein ein EIN " * 50, "中文 字", "9 8"]
    for text, row in zip(texts, made.raw(texts)):
        words = language.hash_batch(language.lowered([text]))
        rows, n = language.subwords(*words[:4])
        want = offset + (table[rows].mean(0) if rows.size else 0)
        assert np.allclose(row, want) and n.sum() == rows.size
    rows, n = language.subwords(*language.hash_batch(["abc"])[:4])
    assert n.tolist() == [1 + 4 + 3 + 2]  # the word, and the runs of 2, 3 and 4 bytes of <abc>


def test_gradient_descent_separates():
    rng = np.random.default_rng(2)
    y = rng.integers(0, 3, 300)
    rows = [(rng.integers(0, 50, 8) + 50 * k).astype(np.int32) for k in y]
    table, offset = language.fit_rows(rows, y, 3)
    z = np.array([table[r].mean(0) for r in rows]) + offset
    assert (z.argmax(1) == y).all()


def test_calibration():
    """Probabilities that are too sure are made milder, and what is accepted is right often enough."""
    rng = np.random.default_rng(3)
    true = rng.dirichlet([0.4, 0.4, 0.4], 20_000)
    y = np.array([rng.choice(3, p=p) for p in true])
    temperature, threshold = language.calibrate(np.log(true + 1e-12) * 3, y)
    assert 2.6 < temperature < 3.4
    p = language.softmax(np.log(true + 1e-12) * 3 / temperature)
    sure = p.max(1) >= threshold
    assert (p.argmax(1)[sure] != y[sure]).mean() <= language.ERROR and 0.01 < sure.mean() < 0.9
    assert language.calibrate(np.zeros((0, 2)), np.zeros(0, int)) == (1.0, 0.0)


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, score string, at int, key int"
    docs = [(i, "der hund und die katze " * 3 if i % 2 else "the dog and the cat " * 3, "de" if i % 2 else "en", "s", 0, 0) for i in range(60)]
    odd = [(None, "the cat", "en", "s", 0, 0), (100, None, "de", "s", 0, 0), (101, "", "de", "s", 0, 0), (102, "12 ²! _", None, "s", 0, 0),
           (103, "die katze", None, "s", 0, 0), (103, "die katze", None, "s", 0, 0), (104, "the dog " * 50_000, None, "s", 0, 0)]
    df = spark.createDataFrame(docs + odd, schema)
    made = language.fit(df)
    out = language.identify(df, made)
    assert out.columns == ["doc_id", "text", "lang", "at", "key", "lang_pred", "score", "rejected"]
    got = {(r.doc_id, r.text and r.text[:9]): (r.lang_pred, r.score, r.rejected) for r in out.collect()}
    assert out.count() == len(docs) + len(odd)
    assert got[None, "the cat"][0] == "en" and got[103, "die katze"][0] == "de" and got[104, "the dog t"][0] == "en"
    assert got[100, None] == got[101, ""] == got[102, "12 ²! _"] == ("und", 0.0, True)
    nothing = language.fit(df.where("false"))
    assert nothing.languages == [] and {r.lang_pred for r in language.identify(df, nothing).collect()} == {"und"}
    assert language.identify(df.where("false"), made).count() == 0
    single = language.fit(df.where("lang = 'de'"))
    assert {(r.lang_pred, r.score) for r in language.identify(df.where("doc_id < 60"), single).collect()} == {("de", 1.0)}
