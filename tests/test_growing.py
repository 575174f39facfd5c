"""Votes that follow changes, merged sketches, the level loop and unreadable input, on small tables with odd rows."""

import glob
import json
import os
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from itemnorm.operators.sketches import merge_sketches, profile_of, profile_sketches
from itemnorm.plans.levels import level_loop
from itemnorm.plans.votes import VoteState
from itemnorm.sources.quarantine import read_quarantined

CHANGE = "item long, key string, category string"


def plain_decisions(votes):
    by = defaultdict(Counter)
    for key, category in votes.values():
        by[key][category] += 1
    out = {}
    for key, n in by.items():
        real = {c: x for c, x in n.items() if c.strip() and c != "nan"}
        if sum(n.values()) >= 2 and real and max(real.values()) * 2 > sum(real.values()):
            out[key] = max(real, key=real.get)
    return out


def test_votes_follow_changes(spark, tmp_path):
    rng, votes = random.Random(4), {}
    state = VoteState(spark, str(tmp_path), 4)
    for step in range(4):
        rows = [(i, rng.choice(["k1", "k2", "k3", None]), rng.choice(["A", "B", "", None])) for i in rng.sample(range(30), 12)]
        rows += [(None, "k1", "A")]
        before = plain_decisions(votes)
        touched = {votes[i][0] for i, _, _ in rows if i in votes} | {k for i, k, _ in rows if i is not None and k}
        for i, key, category in rows:
            if i is None:
                continue
            votes.pop(i, None)
            if key is not None:
                votes[i] = (key, category or "")
        got = {r.key: r.winner for r in state.apply(spark.createDataFrame(rows, CHANGE)).collect()}
        want = plain_decisions(votes)
        assert {k: w for k, w in got.items() if w} == {k: w for k, w in want.items() if k in got}
        assert all(before.get(k) == want.get(k) for k in ("k1", "k2", "k3") if k not in got) and set(got) <= touched
        assert {r.key: r.winner for r in state.decisions().collect()} == want
    state.apply(spark.createDataFrame(rows, CHANGE))  # the same change again
    assert {r.key: r.winner for r in state.decisions().collect()} == want
    assert state.apply(spark.createDataFrame([], CHANGE)).count() == 0 and {r.key: r.winner for r in state.decisions().collect()} == want


def test_a_change_that_dies_changes_nothing(spark, tmp_path):
    state = VoteState(spark, str(tmp_path), 4)
    state.apply(spark.createDataFrame([(1, "k", "A"), (2, "k", "A")], CHANGE))
    state.apply(spark.createDataFrame([(1, "k", "B"), (2, "k", "B")], CHANGE))
    os.remove(f"{tmp_path}/manifest/2/_SUCCESS")  # as if it had died before the end
    assert [(r.key, r.winner) for r in state.decisions().collect()] == [("k", "A")]


def test_only_touched_buckets_are_read(spark, tmp_path):
    state = VoteState(spark, str(tmp_path), 8)
    state.apply(spark.range(200).select(F.col("id").alias("item"), F.concat(F.lit("k"), F.col("id") % 50).alias("key"), F.lit("A").alias("category")))
    before = set(glob.glob(f"{tmp_path}/*/*/bucket=*"))
    state.apply(spark.createDataFrame([(3, "k3", "B")], CHANGE))
    assert len(set(glob.glob(f"{tmp_path}/*/*/bucket=*")) - before) == 2


def test_sketches_add_up(spark):
    df = spark.range(30_000).select(
        F.col("id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("v"), F.col("id"))).alias("many"), F.lit(None).cast("string").alias("none"),
        F.when(F.col("id") % 10 < 7, "x").otherwise("y").alias("few"),
    )
    parts = [profile_sketches(df.where(F.col("id") % 4 == i), ["many", "none", "few"]) for i in range(4)]
    parts.append(profile_sketches(df.where("false"), ["many", "none", "few"]))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    got = {r.column: r for r in profile_of(merge_sketches(every)).collect()}
    assert got["many"].low <= 20_000 <= got["many"].high < 21_500 and (got["many"].non_null, got["many"].nulls) == (20_000, 10_000)
    assert (got["none"].non_null, got["none"].nulls, got["none"].distinct_values, got["none"].top) == (0, 30_000, 0, [])
    assert [(x["item"], x["count"]) for x in got["few"].top] == [("x", 21_000), ("y", 9_000)] and got["few"].distinct_values == 2


def test_level_loop(spark, tmp_path):
    log = str(tmp_path)

    def classify(texts):
        import uuid

        def one(text):
            with open(os.path.join(log, uuid.uuid4().hex), "w") as f:
                f.write(text)
            if "broken" in text:
                raise ValueError("no answer")
            wanted = text.split("Description: ")[1].split("\n")[0].split(" ")
            options = [x[4:] for x in text.split("\n") if x.startswith("  - ")]
            return json.dumps({"selected_category": next((w for w in wanted if w in options), "Odd")})

        return texts.map(one)

    paths = [("MRO|Valves|Ball",), ("MRO|Valves|Gate",), ("MRO|Pumps",), ("Lab|Lab",), ("",), (None,), ("MRO|Pumps",)]
    rows = [(1, "MRO Valves Gate"), (2, "MRO Pumps"), (3, "Lab x"), (4, "MRO thing"), (5, "what"), (6, "broken"), (7, None)]
    items = spark.createDataFrame(rows, "Index long, Description string")
    categories = spark.createDataFrame(paths, "category string")
    got = {r.Index: tuple(r)[1:] for r in level_loop(items, classify, categories).collect()}
    assert got == {
        1: ("MRO|Valves|Gate", 3, None, None), 2: ("MRO|Pumps", 2, None, None), 3: ("Lab", 1, None, None), 4: ("MRO", 1, "Odd", None),
        5: ("", 0, "Odd", None), 6: ("", 0, None, "no answer"), 7: ("", 0, "Odd", None)}
    assert len(os.listdir(log)) == 7 + 3 + 1  # an item that is settled is not asked again
    none = level_loop(items, classify, categories.where("false")).collect()
    assert len(none) == 7 and {r.path for r in none} == {""} and len(os.listdir(log)) == 11


def test_quarantine(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Index,Description\n1,"ball, ""valve"""\nx,pump\n3,\n4,nut,more\n5,bolt\n')
    read = read_quarantined(spark, str(tmp_path / "a.csv"), "Index long, Description string", "csv", ["Description"])
    assert sorted(map(tuple, read.good.collect())) == [(1, 'ball, "valve"'), (5, "bolt")]
    failed = {r.record: r.reason for r in read.failed.collect()}
    assert failed == {"x,pump": "unreadable", "4,nut,more": "unreadable", '{"Index":3}': "lacks Description"}
    assert all(r.file.endswith("a.csv") for r in read.failed.collect())
    (tmp_path / "b.json").write_text('{"Index": 1, "Description": "a"}\n{"Index": "one"}\n[1\n\n')
    read = read_quarantined(spark, str(tmp_path / "b.json"), "Index long, Description string", "json")
    assert [tuple(r) for r in read.good.collect()] == [(1, "a")]
    assert {r.record for r in read.failed.collect()} == {'{"Index": "one"}', "[1"}
