"""Documents whose columns are called like the operators' own."""

import numpy as np

from itemnorm.llm import licenses, sharding, toxicity, weighted_minhash

OWN = ["_content", "_bands", "_row", "_cued", "_score", "_toxicity_score", "node", "root", "best", "slot", "_group", "c0"]
TEXT = "alpha beta gamma delta epsilon zeta eta theta iota kappa"


def docs(spark):
    rows = [(i, TEXT if i < 3 else f"other text number {i} of this small table", *[f"{c}{i}" for c in OWN]) for i in range(6)]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in OWN))


def kept(spark, out, ids):
    want = {r.doc_id: r for r in docs(spark).collect()}
    assert out.columns == docs(spark).columns and {r.doc_id: r for r in out.collect()} == {i: want[i] for i in ids}


def test_minhash(spark):
    kept(spark, weighted_minhash.keep_one(docs(spark)), [0, 3, 4, 5])


def test_toxicity(spark):
    machine = toxicity.Machine(np.full(1 << toxicity.BITS, -1, np.int32), -1.0, np.zeros(0), np.zeros((0, toxicity.RANK)))
    kept(spark, toxicity.clean(docs(spark), machine), range(6))


def test_licenses(spark):
    kept(spark, licenses.scan(docs(spark)).drop("notices"), range(6))


def test_slots(spark):
    out = sharding.with_slots(sharding.assign(docs(spark), "doc_id", [1.0, 1.0]), "shard", ["doc_id"])
    assert out.columns.count("slot") == 1
    for s in (0, 1):
        slots = sorted(r.slot for r in out.where(f"shard = {s}").collect())
        assert slots == list(range(len(slots)))
    assert {(r.doc_id, r["_group"]) for r in out.collect()} == {(r.doc_id, r["_group"]) for r in docs(spark).collect()}
