import itertools

import pytest
from models import chosen_category, described, is_blank
from pyspark.sql import functions as F

from itemnorm.operators import consensus as V
from itemnorm.operators import cost as K
from itemnorm.operators import decide as Z
from itemnorm.operators import enrich as E
from itemnorm.operators import ordering as O
from itemnorm.operators import report as P
from itemnorm.operators import review as R
from itemnorm.operators import taxonomy as Y
from itemnorm.sources import catalog as G
from itemnorm.sources import tables as T


def test_position_is_gapless_over_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    rows = O.with_position(df, ["k"]).collect()
    assert sorted((r.Index, r.k) for r in rows) == [(i + 1, i) for i in range(1000)]
    assert O.add_index(O.add_index(df, ["k"]), ["k"]).columns == ["Index", "k"]


def test_paged_text_continues_long_groups(spark):
    df = spark.createDataFrame([("a", i) for i in range(7)] + [("b", 1)], "g string, i long")
    rows = O.paged_text(df, "g", [F.col("i")], F.col("i").cast("string"), ",", 3).collect()
    assert {(r.g, r.page): r.text for r in rows} == {("a", 0): "0,1,2", ("a", 1): "3,4,5", ("a", 2): "6", ("b", 0): "1"}


def test_final_category_over_all_cases(spark):
    levels = ["high", "medium", "low"]
    cases = list(itertools.product(levels, ["", "A"], ["", "AP"], ["", *levels], ["", "W"], ["", "WP"])) + [
        ("low", "", "UNCATEGORIZED", "", "", "")
    ]
    names = ["ai_confidence", "ai_mapped", "ai_proposed", "web_confidence", "web_mapped", "web_proposed"]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], ["i", *names])
    rows = df.select("i", Z.final_category(*names).alias("d")).orderBy("i").collect()
    assert [(r.d.category, r.d.proposed, r.d.method) for r in rows] == [chosen_category(*c) for c in cases]


def test_confidence_score(spark):
    cases = [("high", "SKF", "C", "valve", "flow", "a long text"), ("low", "", "", "", "", "x"), ("odd", None, "nan", "n", None, None)]
    names = ["confidence", "brand", "mapped", "noun", "category_type", "description"]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i long, " + ", ".join(f"{n} string" for n in names))
    scored = df.withColumn("s", Z.confidence_score(*names)).withColumn("r", Z.needs_review("s")).orderBy("i").collect()
    assert [(r.s, r.r) for r in scored] == [(100, 0), (20, 1), (40, 1)]


def test_descriptions_against_rule(spark):
    nouns = ["valve", "", "nan", "Ball Valve"]
    texts = ["The valve, with (flange) flange steel and more steel", "short", None, "valve ball brass"]
    cases = list(itertools.product(nouns, texts, ["", "SKF"], ["", "ball, sealed", " , "], ["", "SKF", "Brass"], [None, "brass"]))
    names = ["noun", "text", "brand", "modifier", "a", "b"]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i long, " + ", ".join(f"{n} string" for n in names))
    d = Z.normalized_description("noun", "text", "brand", "modifier", ["a", "b"])
    rows = df.select("i", d.alias("d")).orderBy("i").collect()
    assert [r.d for r in rows] == [described(n, t, b, m, [x, y]) for n, t, b, m, x, y in cases]


def test_consensus_needs_more_than_half_and_fills_blanks(spark):
    rows = [(1, "k", "A"), (2, "k", "A"), (3, "k", "B"), (4, "k", ""), (5, "k", None), (6, "t", "A"), (7, "t", "B"), (8, "o", "C"), (9, "e", ""), (10, "e", None)]
    df = spark.createDataFrame(rows, "i long, k string, c string")
    out = {r.i: r.c for r in V.apply_consensus(df, ["c"], F.col("k")).collect()}
    assert [out[i] for i in range(1, 11)] == ["A", "A", "A", "A", "A", "A", "B", "C", "", None]


def test_item_key_falls_back_to_category_type(spark):
    df = spark.createDataFrame([(" Valve", "Sealed, ball", "x"), ("valve", "--", "Flow Control"), (None, None, None)], "n string, m string, c string")
    assert [r[0] for r in df.select(V.item_key("n", "m", "c")).collect()] == ["valve|ball sealed", "valve|control flow", "|"]


def test_category_review_and_decisions(spark):
    rows = [(1, "Valve", "b a", "A"), (2, "valve", "A B", "A"), (3, "valve ", "a-b", "B"), (4, "valve", "a b", None), (5, "nut", "", "C"), (6, "nut", "", "C")]
    df = spark.createDataFrame(rows, "i long, n string, m string, c string")
    review = V.category_review(df, ["n", "m"], "c", "i")
    (row,) = review.collect()
    assert (row.clustering_key, row.variants, row.normalize_to, row.total_rows) == ("Valve + b a", "A (2) ⚫ B (1) ⚫  (1)", "A", 4)
    applied = V.apply_category_decisions(df, ["n", "m"], "c", review.withColumn("normalize_to", F.lit("Z")))
    assert [r.c for r in applied.orderBy("i").collect()] == ["Z", "Z", "Z", "Z", "C", "C"]
    assert R.change_counts(df, applied, "i", ["c", "m"]).collect() == [("c", 4), ("m", 0)]


def test_review_of_values(spark):
    values = ["Valves", "valves", "VALVES", "valves", "Nut", "nut"]
    df = spark.createDataFrame(list(enumerate(values)), "i long, Concept_Noun_Merged string")
    from itemnorm.operators.clustering import collision_clusters

    clusters = collision_clusters(df, "Concept_Noun_Merged", "i")
    review = R.cluster_review(clusters)
    first = review.first()
    assert (first.variants, first.normalize_to, first.variant_count, first.total_rows) == ("valves (2) | Valves (1) | VALVES (1)", "valves", 3, 4)
    decisions = review.withColumn("approve", F.col("cluster_key") == "valves").withColumn("exclude", F.lit("VALVES; x, y"))
    out = R.apply_review(df, "Concept_Noun_Merged", clusters, decisions).orderBy("i").collect()
    assert [r.Concept_Noun_Merged for r in out] == ["valf", "valf", "VALVES", "valf", "Nut", "nut"]


def test_review_pages_share_one_decision(spark):
    df = spark.createDataFrame([(i, "a" + "." * i) for i in range(6)], "i long, v string")
    from itemnorm.operators.clustering import collision_clusters

    clusters = collision_clusters(df, "v", "i")
    review = R.cluster_review(clusters, page_size=2)
    assert sorted(r.page for r in review.collect()) == [0, 1, 2]
    assert {r.v for r in R.apply_review(df, "v", clusters, review).collect()} == {"a"}


def test_export_and_output_columns():
    columns = ["Index", "Brand_Raw", "Web_Noun", "Brand", "Final_Category", "Supplier"]
    assert R.export_columns(columns, "minimal") == ["Brand", "Final_Category"]
    assert R.export_columns(columns) == ["Brand", "Final_Category", "Index", "Supplier"]
    assert R.export_columns(columns, "full") == columns
    with pytest.raises(ValueError):
        R.export_columns(columns, "other")
    assert Z.output_column_list([*columns, "Description", "Needs_Review"]) == ["Index", "Description", "Brand", "Needs_Review", "Supplier"]


ANSWERS = [
    '{"language": " EN ", "brand": "skf", "concept_noun": "Valve", "confidence": "HIGH", "attributes": {"material": " brass ", "n": 3, "x": null}}',
    '```json\n{"brand": "m", "is_product_or_service": "Service"}\n```',
    'Sure: {"brand": null, "modifier": null} bye',
    "no json",
    '{"brand": "x", ',
    None,
]


def test_parse_responses(spark):
    df = spark.createDataFrame(list(enumerate(ANSWERS)), "i long, content string")
    rows = [r.r for r in df.select("i", E.parse_response("content").alias("r")).orderBy("i").collect()]
    assert (rows[0].language, rows[0].brand, rows[0].concept_noun, rows[0].confidence) == ("en", "SKF", "valve", "high")
    assert rows[0].attributes == {"material": "brass", "n": "3", "x": ""}
    assert (rows[1].brand, rows[1].is_product_or_service, rows[1].confidence) == ("", "Service", "low")
    for r in rows[2:]:
        assert (r.brand, r.modifier, r.is_product_or_service, r.confidence, r.attributes) == ("", "", "Product", "low", {})


def test_enrich_isolates_failures(spark):
    def classify(texts):
        if texts.str.contains("bad").any():
            raise ValueError("refused")
        return texts.str.upper()

    df = spark.createDataFrame([(i, "bad" if i == 3 else f"t{i}") for i in range(8)], "i long, t string")
    rows = E.enrich(df, classify, "t", ["i"], tasks=2).orderBy("i").collect()
    assert [r.content for r in rows] == ["T0", "T1", "T2", None, "T4", "T5", "T6", "T7"]
    assert [r.error for r in rows if r.error] == ["refused"]
    both = E.enrich(df, classify, "t", ["i"], batch=8, around=("<", ">")).orderBy("i").collect()
    assert {r.content for r in both} == {None} or "<T0>" in {r.content for r in both}
    assert sum(r.error == "refused" for r in both) + sum(r.content is not None for r in both) == 8


def test_requests(spark):
    df = spark.createDataFrame([("valve", "ACME", "nan"), ("nut", None, "x")], "d string, s string, g string")
    context = E.context_text({"Supplier": "s", "Group": "g"})
    text = E.request_text("d", context, template=F.lit(E.json_template(["material"], True)))
    first, second = [r[0] for r in df.select(text).collect()]
    assert first.endswith("Description: valve\n\nADDITIONAL CONTEXT\nSupplier: ACME") and "Group: x" in second
    assert '"material": ""' in first and '"mapped_category": ""' in first
    own = E.request_text("d", context, layout="Say what {description} is. {context}")
    assert df.select(own).first()[0].startswith("Say what valve is. ")


def test_needs_evidence_levels(spark):
    df = spark.createDataFrame([("low",), ("Medium",), ("high",), (None,)], "c string")
    flags = lambda **o: [r[0] for r in df.select(E.needs_evidence("c", **o)).collect()]
    assert flags() == [True, False, False, True] and flags(level="medium") == [True, True, False, True]
    assert not any(flags(web_enabled=False))


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, 'ball "valve", 2\nlines'), (2, "nut")], "Index long, Description string")
    for fmt in ("parquet", "csv", "json", "orc"):
        T.write_table(df, f"{tmp_path}/t.{fmt}")
        lines = {"multiLine": "true"} if fmt == "csv" else {}
        back = T.read_items(spark, f"{tmp_path}/t.{fmt}", **lines).select("Index", "Description").orderBy("Index")
        assert back.collect() == df.collect()
    with pytest.raises(ValueError):
        T.read_items(spark, f"{tmp_path}/t.csv", description="Text")
    with pytest.raises(ValueError):
        T.read_table(spark, f"{tmp_path}/t.xlsx")
    T.append_finished(df.filter("Index = 1"), f"{tmp_path}/done")
    assert E.resume_pending(df, spark.read.parquet(f"{tmp_path}/done"), "Index").collect() == df.filter("Index = 2").collect()


def test_taxonomy(spark):
    levels = spark.createDataFrame([(" MRO ", "Valves"), ("Lab", None), ("nan", "x")], "Level1 string, Level2 string")
    assert T.taxonomy(levels).collect() == [("MRO|Valves",)]
    flat = spark.createDataFrame([("MRO|Bearings|Ball Bearings",), (" MRO|Valves ",), ("Fac|Fac",), ("",)], "Category string")
    paths = T.taxonomy(flat)
    rows = {(r.level, r.parent, r.child): (r.children, r.leaf) for r in Y.taxonomy_children(paths).collect()}
    assert rows[(1, "", "MRO")] == (2, False) and rows[(2, "MRO", "Valves")] == (0, True)
    assert rows[(1, "", "Fac")] == (1, True) and rows[(2, "MRO", "Bearings")] == (1, False)
    assert Y.taxonomy_summary(paths).collect() == [(3, 2, 3)]
    with pytest.raises(ValueError):
        T.taxonomy(spark.createDataFrame([("x",)], "other string"))


def test_attribute_sets_and_default(spark):
    wide = spark.createDataFrame([("S", "Material", None, " UOM "), ("E", None, "", None)], "Attribute_Set string, Att1 string, Att2 string, Att3 string")
    mapping = spark.createDataFrame([("MRO ", "S")], "Level1_Category string, Attribute_Set string")
    items = spark.createDataFrame([(1, "MRO|x"), (2, "Lab"), (3, None)], "i long, c string")
    rows = Y.attach_attribute_set(items, "c", mapping, T.attribute_sets(wide)).orderBy("i").collect()
    assert (rows[0].attribute_set, rows[0].attributes) == ("S", ["Material", "UOM"])
    assert {(r.attribute_set, len(r.attributes)) for r in rows[1:]} == {("Default_Set", 20)}


def test_catalog(spark):
    catalog = G.attribute_catalog(spark, {"Grip Type": {"description": "kind of grip", "examples": "soft"}})
    assert catalog.count() == 48 and G.attribute_info(catalog, "Grip_Type").first().key == "grip_type"
    assert [G.group_attributes(catalog, g).count() for g in G.GROUPS] == [10, 7, 5, 8, 6, 6, 5]
    with pytest.raises(ValueError):
        G.attribute_catalog(spark, {"Material": {}})
    picked = spark.createDataFrame([("s", "UOM"), ("s", "Material"), ("s", "Grip_Type")], "set string, name string")
    lines = G.attribute_section(picked, catalog, "set").first().section.split("\n")
    assert lines[1].startswith('- material: ') and lines[3] == '- grip_type: kind of grip (e.g. "soft")'


def test_reports(spark):
    rows = [(1, "d", "N", "B1", None), (2, "d", "N", None, "n2"), (3, "d", "N", "B2", "n3"), (4, "d", "N", "B1", "n4"), (5, "d", "M", "B", "n")]
    df = spark.createDataFrame(rows, "i long, Description string, Normalized_Description string, Brand string, Concept_Noun string")
    assert P.benchmark_items(df, "i").collect() == [("N", 4, "B1, B2", "n2"), ("M", 1, "B", "n")]
    profile = {r.column: r for r in P.column_profile(df, ["Brand", "Description"], "i").collect()}
    assert (profile["Brand"].non_null, profile["Brand"].nulls, profile["Brand"].distinct_values, profile["Brand"].samples) == (4, 1, 3, "B1 | B2 | B")
    rough = {r.column: r.distinct_values for r in P.column_profile(df, ["Brand"], "i", approximate=True).collect()}
    assert rough == {"Brand": 3}
    top = P.attribute_top_values(df, ["Brand", "Concept_Noun"], top=1).collect()
    assert {(r.attribute, r.value, r["count"]) for r in top} == {("Brand", "B1", 2), ("Concept_Noun", "n", 1)}


def test_number_texts_round_as_printf(spark):
    values = [0.5, 1.5, 10.5, 1.05, 1.15, 1.25, 1.35, 2.675, 0.125, 0.135, 59.95, 0.29, 7.0, 0.0] + [i / 40 for i in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 1, 2):
        assert [r[0] for r in df.select(P.fixed_text("x", digits)).collect()] == [f"{v:.{digits}f}" for v in values]
    times = spark.createDataFrame([(59.0,), (90.0,), (5400.0,)], "s double").select(P.duration_text("s")).collect()
    assert [r[0] for r in times] == ["59s", "1.5 min", "1.5 hours"]


def test_cost(spark):
    usage = spark.createDataFrame([("m", 1000000, 500000, "google"), ("m", 0, 500000, "perplexity"), ("u", 5, 5, "")], "model string, input_tokens long, output_tokens long, provider string")
    prices = spark.createDataFrame([("m", 0.25, 2.0)], "model string, input double, output double")
    rows = {r.model: r for r in K.usage_cost(usage, prices).collect()}
    assert rows["m"].ai_cost == 2.25 and rows["m"].search_cost == 0.005 + 0.003 and rows["u"].total_cost == 0.0
    batches = spark.createDataFrame([("b", "m", 100)], "batch string, model string, num_rows long")
    row = K.cost_estimate(batches, prices, 0.25, 0.1, "google").first()
    assert (row.keyword_matches, row.ai_calls, row.web_searches, row.input_tokens, row.output_tokens) == (25, 75, 10, 67000, 8000)
    assert row.web_cost == 0.05 and row.estimated_seconds == 100 * 0.1 + 65 * 8 / 10 + 15.0


def test_blank_rule_of_the_model():
    assert is_blank(" ") and is_blank("NaN") and not is_blank(" nan ")


def test_pages_of_a_review_decide_together(spark):
    from itemnorm.operators import review as R

    rows = [("k", f"v{i}", 9 - i, i) for i in range(5)] + [("m", "a", 3, 0), ("m", "b", 2, 1), ("m", "c", 1, 2)]
    clusters = spark.createDataFrame(rows, "cluster_key string, value string, n long, first_pos long")
    review = R.cluster_review(clusters, page_size=2)
    assert [(r.cluster_key, r.page, r.variants) for r in review.collect()][:3] == [
        ("k", 0, "v0 (9) | v1 (8)"), ("k", 1, "v2 (7) | v3 (6)"), ("k", 2, "v4 (5)")]

    def edited(**cells):
        out = review
        for name, (key, page, value) in cells.items():
            here = (F.col("cluster_key") == key) & (F.col("page") == page)
            name = name.rstrip("2")
            out = out.withColumn(name, F.when(here, F.lit(value)).otherwise(F.col(name)))
        return out

    mapping = lambda d: {r.value: r.canonical for r in R.review_mapping("x", clusters, d).collect()}
    every = mapping(review)
    assert every == {"v1": "v0", "v2": "v0", "v3": "v0", "v4": "v0", "b": "a", "c": "a"}
    assert set(every) - set(mapping(edited(exclude=("k", 1, "v3; v1")))) == {"v1", "v3"}
    assert set(mapping(edited(approve=("k", 2, False)))) == {"b", "c"}
    assert mapping(edited(normalize_to=("m", 1, "Z"))) == {**every, "a": "Z", "b": "Z", "c": "Z"}
    torn = edited(normalize_to=("k", 1, "Y"), normalize_to2=("k", 2, "X"))
    assert set(mapping(torn)) == {"b", "c"} and [r[0] for r in R.review_conflicts(clusters, torn).collect()] == ["k"]


def test_guidance_covers_the_catalog():
    from itemnorm.sources import catalog as G

    rows = {r[2]: r for r in G.catalog_rows()}
    assert set(rows) == set(G.HINTS) and len(rows) == 47
    assert rows["IP_Rating"][1:] == ("Electrical", "IP_Rating", "ip_rating", "ingress code of the housing", "IP20", "IP54")


def test_answers_are_read_strictly(spark):
    texts = ['{"brand":"SKF","attributes":{"material":"steel","n":0,"b":false,"z":"0","x":null}}', "{'brand': 'SKF'}",
             '{"brand":"SKF"} or maybe {"brand":"ABB"}', '```json\n{"brand":"ABB"}\n```']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string")
    got = [r.p for r in df.select("i", E.parse_response("c").alias("p")).orderBy("i").collect()]
    assert [p.brand for p in got] == ["SKF", "", "", "ABB"]
    assert got[0].attributes == {"material": "steel", "n": "", "b": "", "z": "0", "x": ""}


def test_category_list(spark):
    paths = ["b|é", "a|x", "b", None, "a|x", "c d"]
    categories = spark.createDataFrame([(p,) for p in paths], "category string")
    whole = "  - a|x\n  - b\n  - b|é\n  - c d"
    assert Y.category_list_text(categories) == whole
    assert {(r.page, r.options) for r in Y.category_pages(categories, 3).collect()} == {
        (0, "  - a|x\n  - b\n  - b|é"), (1, "  - c d")
    }
    assert Y.category_list_text(categories, limit=len(whole)) == whole
    with pytest.raises(ValueError, match="level by level"):
        Y.category_list_text(categories, limit=len(whole) - 1)
    assert Y.category_list_text(categories.limit(0)) == ""
