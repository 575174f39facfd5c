"""Learning batch by batch against learning in one go."""

import os
import random

import pytest

from itemnorm.operators.clustering import normalize_column
from itemnorm.plans.learning import Learner


def test_parts_equal_one_go(spark, tmp_path):
    rng = random.Random(8)
    words = ["steel ball valve", "hex nuts", "gate valve brass", "болт", "гайка", "--", "washers flat"]

    def one():
        w = rng.choice(words)
        x = rng.random()
        return None if x < 0.05 else " nan " if x < 0.1 else w.upper() if x < 0.3 else w + "s" if x < 0.5 else w.replace("e", "ee", 1) if x < 0.7 else w

    rows = [(1, "Pump")] + [(i, one()) for i in range(2, 70)]
    df = spark.createDataFrame(rows, "Index long, v string")
    learner = Learner(spark, str(tmp_path), "noun")
    assert learner.mapping().count() == 0
    assert [tuple(r) for r in learner.learn(df.where("Index = 1"), "v", "Index").collect()] == [("Pump", "pump")]
    learner.learn(df.where("Index between 2 and 40"), "v", "Index")
    got = learner.learn(df.where("Index > 40"), "v", "Index")
    want = normalize_column(df, "v", "Index", "noun").mapping
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert learner.learn(df.where("false"), "v", "Index").count() == got.count()
    with pytest.raises(ValueError):
        learner.learn(df.where("Index = 5"), "v", "Index")
    os.remove(f"{tmp_path}/commit/3/_SUCCESS")  # the third batch died: it is learned again
    again = learner.learn(df.where("Index > 40"), "v", "Index")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, want.collect()))
