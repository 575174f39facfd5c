import random

import pytest
from models import grams, jaccard, leaders, normalized, ratio

from itemnorm.functions.text import character_bag, ngrams
from itemnorm.operators import clustering as C
from itemnorm.operators import similarity as S


def _texts(seed, groups=25, letters="abcde"):
    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        base = [rng.choice(letters) for _ in range(rng.randint(1, 25))]
        out.append("".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = rng.choice(letters)
            out.append("".join(copy))
    rng.shuffle(out)
    seen = {}
    for t in out:
        seen.setdefault(grams(t), t)
    return list(seen.values())


def _nodes(spark, texts, tokens):
    return spark.createDataFrame(list(enumerate(texts)), "node long, text string").withColumn("tokens", tokens("text"))


@pytest.mark.parametrize("seed,threshold,limit", [(1, 0.85, 2000), (2, 0.4, 3)])
def test_pairs_equal_brute_force(spark, seed, threshold, limit, tmp_path):
    texts = _texts(seed)
    nodes = _nodes(spark, texts, ngrams)
    want = {
        (a, b)
        for a in range(len(texts))
        for b in range(a + 1, len(texts))
        if jaccard(grams(texts[a]), grams(texts[b])) >= threshold
    }
    signed = S.signatures(nodes, threshold)
    pairs = S.candidates(signed, signed, threshold, folder=str(tmp_path), name="t", limit=limit)
    rows = S.jaccard_verify(nodes, threshold)(pairs).collect()
    assert len(rows) == len(want) and {(r.a, r.b) for r in rows} == want


@pytest.mark.parametrize("seed,threshold,tuning", [(3, 0.85, {}), (4, 0.4, {"first_batch": 20, "growth": 3, "limit": 4})])
def test_leaders_equal_the_sequential_rule(spark, seed, threshold, tuning):
    texts = _texts(seed)
    nodes = _nodes(spark, texts, ngrams)
    rows = S.greedy_leaders(nodes, threshold, S.jaccard_verify(nodes, threshold), **tuning).collect()
    want = leaders(texts, lambda a, b: jaccard(grams(a), grams(b)) >= threshold)
    assert {texts[r.node]: texts[r.leader] for r in rows} == want and len(rows) == len(texts)


def test_leaders_are_not_connected_components(spark):
    """A chain of equally near neighbours: the second joins the first, the third leads again."""
    nodes = spark.createDataFrame(
        [(i, [str(k) for k in range(i, i + 10)]) for i in range(7)], "node long, tokens array<string>"
    )
    threshold = 9 / 11
    rows = S.greedy_leaders(nodes, threshold, S.jaccard_verify(nodes, threshold)).collect()
    assert {r.node: r.leader for r in rows} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4, 6: 6}


def test_rows_of_a_nodes_parts_are_grouped_where_they_are(spark):
    nodes = _nodes(spark, _texts(5), ngrams)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        signed = S.signatures(nodes, 0.7)
        plan = signed._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    dealt = [line.split("Exchange ")[1] for line in plan.splitlines() if "Exchange " in line]
    assert dealt and not any("part#" in d or "level#" in d for d in dealt), plan
    assert signed.groupBy("node", "level", "part").count().filter("count > 1").isEmpty()


def test_dense_group_does_not_depend_on_batches(spark):
    """A third of all nodes are near copies of one text."""
    copies = [f"the same long purchase text number {i:04d} for one item" for i in range(150)]
    others = _texts(9, 80, "abcdefghij")
    texts = [t for pair in zip(copies, others) for t in pair]
    texts = list({grams(t): t for t in texts}.values())
    nodes = _nodes(spark, texts, ngrams)
    near = lambda a, b: jaccard(grams(a), grams(b)) >= 0.8
    rows = S.greedy_leaders(nodes, 0.8, S.jaccard_verify(nodes, 0.8), first_batch=30, growth=4, limit=10).collect()
    assert {texts[r.node]: texts[r.leader] for r in rows} == leaders(texts, near)


@pytest.mark.parametrize("threshold", [0.8, 0.6])
def test_sequence_pairs_and_clusters(spark, threshold):
    texts = list(dict.fromkeys(_texts(6, 15) + ["tide", "diet", "Tide"]))
    df = spark.createDataFrame(list(enumerate(texts)), "i long, v string")
    lower = list(dict.fromkeys(t.lower() for t in texts))
    want = {(a, b) for i, a in enumerate(lower) for b in lower[i + 1 :] if ratio(a, b) >= threshold}
    got = {(r.left_key.lower(), r.right_key.lower()) for r in C.fuzzy_similar_pairs(df, "v", "i", threshold).collect()}
    assert got == want
    lead = leaders(texts, lambda a, b: ratio(a, b) >= threshold)
    size = {v: list(lead.values()).count(v) for v in lead.values()}
    clusters = C.fuzzy_clusters(df, "v", "i", threshold).collect()
    assert {(r.value, r.cluster_key) for r in clusters} == {(v, k) for v, k in lead.items() if size[k] > 1}


def test_character_bag_bounds_the_ratio(spark):
    texts = _texts(11, 10)
    df = _nodes(spark, texts, character_bag)
    bags = {r.node: set(r.tokens) for r in df.collect()}
    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            assert jaccard(bags[a], bags[b]) + 1e-9 >= S.sequence_token_threshold(max(ratio(texts[a], texts[b]), 1e-9))


def test_normalizer_against_rule(spark):
    rng = random.Random(8)
    base = ["Ball Valve", "ball-valve", "BALL VALVE", "valve, ball", "Gasket", "gaskets", "gasket set", "--", "..", "nan", "", " pump ", "Pump", "pumps", "болт", "гайка", "bearing 6205", "bearing 6206"]
    values = [rng.choice(base) for _ in range(120)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v string").repartition(5)
    got = {r.value: r.canonical for r in C.normalize_column(df, "v", "i").mapping.collect()}
    assert got == normalized(values)


def test_normalizer_single_value_keeps_case(spark):
    df = spark.createDataFrame([(1, "Ball Valves"), (2, " Ball Valves "), (3, "")], "i long, v string")
    assert [r.canonical for r in C.normalize_column(df, "v", "i").mapping.collect()] == ["Ball Valves"]
    assert [r.canonical for r in C.normalize_column(df, "v", "i", "noun").mapping.collect()] == ["ball valf"]


def test_unicode_ngrams_keep_cyrillic_apart(spark):
    df = spark.createDataFrame([(1, "болт"), (2, "гайка")], "i long, v string")
    forms = lambda **o: {r.canonical for r in C.normalize_column(df, "v", "i", **o).mapping.collect()}
    assert len(forms()) == 1 and len(forms(unicode_ngrams=True)) == 2


def test_mapping_join_keeps_unknown_values(spark):
    df = spark.createDataFrame([(1, " SKF Inc. "), (2, "other"), (3, "nan"), (4, None)], "i long, v string")
    mapping = spark.createDataFrame([("SKF Inc.", "skf")], "value string, canonical string")
    rows = C.apply_mapping(df, "v", mapping, "o").orderBy("i").collect()
    assert [r.o for r in rows] == ["skf", "other", "", ""]
    assert C.apply_mapping(df, "v", mapping, "o", keep_blank=True).orderBy("i").collect()[3].o is None


def test_collision_clusters_use_exact_values(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "B A"), (3, " a b"), (4, "c"), (5, "--"), (6, None)], "i long, v string")
    rows = C.collision_clusters(df, "v", "i").collect()
    assert {r.value for r in rows} == {"a b", "B A", " a b"} and {r.variants for r in rows} == {3}
    with pytest.raises(ValueError):
        C.collision_clusters(df, "v", "i", method="other")


def test_collision_clusters_shuffle_only_texts_of_shared_keys(spark, monkeypatch):
    rows = [(i, f"text {i:03d} alone") for i in range(200)] + [(i, ["b a", "A b", "a, b", "x y", "Y x"][i % 5]) for i in range(200, 220)]
    df = spark.createDataFrame([*rows, (220, "--"), (221, ""), (222, None), (222, "b a")], "i long, v string").repartition(7)
    for method, sizes in (("fingerprint", [2, 2, 3, 3, 3]), ("ngram", [2, 2])):
        found = []
        for sent in (10**6, 0):
            monkeypatch.setattr(C, "SENT", sent)
            clusters = C.collision_clusters(df, "v", "i", method=method)
            found.append((clusters.columns, {tuple(r) for r in clusters.collect()}))
            plan = clusters._jdf.queryExecution().optimizedPlan().toString()
            assert plan.count("Join LeftSemi") == (2 if sent else 0), plan
        assert found[0] == found[1] and sorted(r[4] for r in found[0][1]) == sizes


def test_order_must_be_unique(spark):
    df = spark.createDataFrame([(1, "valve"), (1, "gasket"), (2, "nut")], "i long, v string")
    with pytest.raises(ValueError):
        C.normalize_column(df, "v", "i")


def test_long_chain_settles(spark, monkeypatch):
    """Every node resembles the next only: odd ones join, even ones lead, after many rounds."""
    monkeypatch.setattr(S, "COMPACT_EVERY", 3)
    nodes = spark.createDataFrame([(i, [str(k) for k in range(i * 2, i * 2 + 6)]) for i in range(15)], "node long, tokens array<string>")
    rows = S.greedy_leaders(nodes, 0.5, S.jaccard_verify(nodes, 0.5)).collect()
    assert {r.node: r.leader for r in rows} == {i: i - i % 2 for i in range(15)}


def test_summary(spark):
    """valf (of valves), valve and nut remain of the lower-case values valve, valves and nut."""
    df = spark.createDataFrame([(1, "valve"), (2, "Valve"), (3, "valves"), (4, "nut")], "i long, v string")
    row = C.normalize_column(df, "v", "i", "noun").summary().first()
    assert (row.unique_values, row.clustered) == (3, 0)


@pytest.mark.parametrize("seed,threshold,block", [(6, 0.85, 50), (7, 0.5, 1000)])
def test_grid_pairs_equal_brute_force(spark, seed, threshold, block, monkeypatch):
    """Sets of many sizes in blocks of few nodes; one side with itself, and two sides with each other."""
    monkeypatch.setattr(S, "BLOCK", block)
    rng = random.Random(seed)
    sets = {}
    for i in range(150):
        near = sets[rng.randrange(i)] if i and rng.random() < 0.5 else set(rng.sample(range(400), rng.choice([1, 2, 5, 30, 150])))
        sets[i] = near ^ set(rng.sample(range(400), rng.randrange(3))) or {i}
    nodes = spark.createDataFrame([(i, [str(t) for t in s]) for i, s in sets.items()], "node int, tokens array<string>")
    near = lambda a, b: len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9
    want = {(a, b) for a in sets for b in sets if a < b and near(a, b)}
    short = S.sketches(nodes).cache()
    odd = short.limit(1).selectExpr("cast(null as int) as node", "size", "w0", "w1", "w2", "w3")
    pairs = S.grid_candidates(both := short.unionByName(odd), both, threshold)
    got = S.jaccard_verify(nodes, threshold)(pairs).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want) > 20
    assert pairs.schema["a"].dataType == nodes.schema["node"].dataType
    between = S.grid_candidates(short.filter("node < 100"), short.filter("node >= 50"), threshold)
    got = {(r.a, r.b) for r in S.jaccard_verify(nodes, threshold)(between).collect()}
    assert got == {(a, b) for a, b in want if a < 100 and b >= 50}
    if threshold > 0.8:
        led = S.greedy_leaders(nodes, threshold, S.jaccard_verify(nodes, threshold), first_batch=100, grid=True).collect()
        assert {r.node: r.leader for r in led} == leaders(list(sets), near) and len(led) == len(sets)
    assert S.grid_candidates(short.limit(0), short.limit(0), threshold).count() == 0


def test_bigram_sets_are_written_once(spark, monkeypatch):
    """No table holds a row per part of a set, whose number grows with the set."""
    rows = {}

    def noted(df, folder, name, cut=S.cut):
        out = cut(df, folder, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(S, "cut", noted)
    texts = ["the quick brown fox jumps over the lazy dog", "the quick brown fox jumps over the lazy dogs", "pack my box with five dozen jugs"]
    keys = spark.createDataFrame(list(enumerate(texts)), "i long, key string")
    pairs = C.ngram_similar_pairs(keys, "key", "i").collect()
    assert [(r.left_key, r.right_key) for r in pairs] == [(texts[0], texts[1])] and rows == {"sketches": 3, "candidates": 1}


def test_leaders_of_bigram_sets_have_no_row_per_part(spark, monkeypatch):
    rows = {}

    def noted(df, folder, name, cut=S.cut):
        out = cut(df, folder, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(S, "cut", noted)
    texts = ["the quick brown fox jumps over the lazy dog", "pack my box with five dozen jugs", "the quick brown fox jumps over the lazy dogs"]
    keys = spark.createDataFrame(list(enumerate(texts)), "i long, key string")
    led = C.leader_clusters(keys, "key", "i", first_batch=2).collect()
    assert {r.position: r.cluster for r in led} == {0: 0, 1: 1, 2: 0} and rows["signatures"] == 3
