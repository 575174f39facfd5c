"""The sequence ratio against the standard library's."""

import random
from difflib import SequenceMatcher

import pytest

from itemnorm.operators.sequence import sequence_ratios


def pairs_of(seed):
    rng = random.Random(seed)
    text = lambda letters, n: "".join(rng.choice(letters) for _ in range(rng.randint(0, n)))

    def changed(s, share):
        out = []
        for c in s:
            x = rng.random()
            out.append("" if x < share else c + rng.choice("ab ") if x < 2 * share else c)
        return "".join(out)

    found = [("", ""), ("a", ""), ("", "b"), ("ab", "ba"), ("é中𝒳a", "𝒳aé中"), ("abcd" * 60, "bcda" * 60), ("x" * 250, "x" * 250), ("tide", "diet"), ("diet", "tide")]
    found += [(text("ab", 12), text("ab", 12)) for _ in range(60)]
    found += [(s, changed(s, 0.1)) for s in (text("abcde fgh", 60) for _ in range(40))]
    # texts of 200 characters and more, in which frequent characters begin no run
    found += [(s, changed(s, 0.03)) for s in (text("abcdefghijklmnopqrstuvwxyz0123456789", 420) for _ in range(12))]
    found += [(s, changed(s, 0.03)) for s in ("".join(chr(0x4E00 + rng.randint(0, 400)) for _ in range(230)) + text("ab", 90) for _ in range(8))]
    return found


@pytest.mark.parametrize("threshold", [0.0, 0.8])
def test_like_the_standard_library(spark, threshold):
    found = pairs_of(5)
    rows = [(i, -i, x, y) for i, (x, y) in enumerate(found)] + [(1000, 0, None, "a"), (1001, 0, "a", None)]
    df = spark.createDataFrame(rows, "a long, b long, left string, right string").repartition(4)
    got = {r.a: r.similarity for r in sequence_ratios(df, threshold).collect()}
    want = {i: SequenceMatcher(None, x, y).ratio() for i, (x, y) in enumerate(found)}
    want = {i: r for i, r in want.items() if r >= threshold}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)


def test_no_pairs(spark):
    none = spark.createDataFrame([], "a long, b long, left string, right string")
    assert sequence_ratios(none, 0.5).collect() == []
