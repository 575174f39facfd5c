import random
import unicodedata

import pytest
from models import fingerprint, grams

from itemnorm.functions import attributes as A
from itemnorm.functions import text as X

EDGES = ["", None, "nan", "  NaN ", "--", "É_a-b", "ﬁtting", "болт", "гайка", "a", "ab", "\tx y\n", " z ", "½ in²", "한글 각", "ﾊﾟ", "éa", "İx"]


def _apply(spark, values, **columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v string")
    rows = df.select("i", *[c.alias(n) for n, c in columns.items()]).orderBy("i").collect()
    return [tuple(r[n] for n in columns) if len(columns) > 1 else r[next(iter(columns))] for r in rows]


def _random_texts(n, seed=3):
    pool = "abcXYZ019 _-,.\t\x1céÉßñÅåçИΣςﬁ½²Ⅳяёй한각ｶﾞ日本ु🙂"
    rng = random.Random(seed)
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def test_fingerprint_against_rule(spark):
    values = EDGES + _random_texts(500)
    assert _apply(spark, values, f=X.key_fingerprint("v")) == [fingerprint(v) for v in values]


@pytest.mark.parametrize("text,expected", [("Ball Valve, SS", "ball ss valve"), ("call-out", "call out")])
def test_fingerprint_examples(spark, text, expected):
    assert _apply(spark, [text], f=X.key_fingerprint("v")) == [expected]


def test_fingerprint_is_idempotent_and_ignores_order(spark):
    once = _apply(spark, _random_texts(200, 5), f=X.key_fingerprint("v"))
    turned = [" ".join(reversed(v.split(" "))) for v in once]
    assert _apply(spark, turned, f=X.key_fingerprint("v")) == once


@pytest.mark.parametrize("n", [2, 3])
def test_ngrams_against_rule(spark, n):
    values = EDGES + _random_texts(300, 7)
    got = _apply(spark, values, g=X.ngrams("v", n), s=X.ngram_fingerprint("v", n))
    assert [frozenset(g) for g, _ in got] == [grams(v, n) for v in values]
    assert [s for _, s in got] == ["".join(sorted(grams(v, n))) for v in values]


def test_unicode_ngrams_keep_other_scripts(spark):
    assert _apply(spark, ["болт"], a=X.ngrams("v"), b=X.ngrams("v", 2, True)) == [([""], ["бо", "ол", "лт"])]


def test_character_bag_counts_repeats(spark):
    assert sorted(_apply(spark, ["AbaA"], b=X.character_bag("v"))[0]) == ["a1", "a2", "a3", "b1"]


def test_blank(spark):
    got = _apply(spark, ["", None, " ", "nan", "NaN", " nan ", "x", " "], b=X.blank("v"))
    assert got == [True, True, True, True, True, False, False, True]


def test_singularize(spark):
    words = ["batteries", "valves", "boxes", "pliers", "glass", "gas", "series", "ball valves", "dishes", "plates", "ties", ""]
    assert _apply(spark, words, s=X.singularize("v")) == [
        "battery", "valf", "box", "pliers", "glass", "gas", "series", "ball valf", "dish", "plate", "tie", "",
    ]


def test_singularize_review(spark):
    words = ["batteries", "ves", "gas", "glasses", "pliers", "uses", "ties"]
    assert _apply(spark, words, s=X.singularize_review("v")) == ["battery", "f", "ga", "glass", "plier", "use", "tie"]


def test_category_and_brand_rules(spark):
    texts = ["Valve Category", "class  A  type", "subclass", "msa", "Acme, Inc.", "SKF GmbH", "AG", "Parker co"]
    got = _apply(spark, texts, c=X.clean_category_type("v"), b=X.clean_brand_suffix("v", True), w=X.clean_brand_suffix("v"))
    assert [g[0] for g in got][:3] == ["valve", "a", "subclass"]
    assert [g[1] for g in got][3:] == ["m", "acme,", "skf", "", "parker"]
    assert [g[2] for g in got][3:] == ["msa", "acme", "skf", "ag", "parker"]


def test_valid_brand(spark):
    assert _apply(spark, [" skf", "m", "n/a", "None", None, "3M"], b=X.valid_brand("v")) == ["SKF", "", "", "", "", "3M"]


def test_attribute_rules(spark):
    sizes = ["1/2in", "1/3", "3/4 inch", "2 Inches", "5 millimeters", "1/0", "nan", None, "7 centimeter"]
    assert _apply(spark, sizes, s=A.normalize_size("v")) == ["0.5in", f"{1 / 3}in", "0.75inch", "2in", "5mm", "1/0", "", "", "7cm"]
    assert _apply(spark, ["SS", "Teflon", "Wood ", "NAN"], s=A.normalize_material("v")) == ["stainless steel", "ptfe", "wood", ""]
    assert _apply(spark, ["npt", "metric", "m8"], s=A.normalize_thread("v")) == ["NPT", "Metric", "M8"]


def test_all_scripts_fold_like_the_standard(spark):
    texts = [chr(c) + "x" for c in range(0xC0, 0x2000) if unicodedata.category(chr(c))[0] in "LNM"]
    got = _apply(spark, texts, f=X.key_fingerprint("v"))
    wrong = [t for t, g in zip(texts, got) if g != fingerprint(t)]
    # Letters newer than the Unicode data of the JVM count as punctuation there.
    assert len(wrong) < 60 and all(not ("À" <= w[0] < "ࡠ") for w in wrong)
