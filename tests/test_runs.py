import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check import compare
from itemnorm.operators.clustering import apply_mapping
from itemnorm.plans.renormalize import renormalize, run
from itemnorm.sources.tables import load_mapping, save_mapping
from itemnorm.plans.waves import ask_in_waves, committed
from itemnorm.streaming.streams import append_stream, apply_mapping_stream, compact, finished_rows, item_stream, process_stream
from registry.fixtures import BASE, table

SF = "/root/testdata/sf0.001"
# Those that run many small jobs are compared in check.py.
SLOW = {
    "ngram_similar_pairs", "leader_clusters", "normalize_category_type", "normalize_modifier", "normalize_brand",
    "normalization_summary", "run_stats", "fuzzy_similar_pairs", "fuzzy_clusters", "normalize_noun",
    "learn_in_parts", "nearest_category",
}
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@needs_data
@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.LLM_QUERIES) - SLOW))
def test_query_equals_its_sql(spark, duck, name):
    assert compare(spark, duck, name, SF).startswith("ok")


@needs_data
def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["canonical", "n_rows"] and df.agg(F.sum("n_rows")).first()[0] == 200


@needs_data
def test_result_does_not_depend_on_partitioning(spark):
    stored = table(spark, SF, "checkpoint")
    a = renormalize(stored).table
    b = renormalize(stored.repartition(7, "Material"), first_batch=4, growth=2, limit=2).table
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def _classifier():
    """A function within a function travels to the workers by value."""

    def answer(text):
        line = next(x for x in text.split("\n") if x.startswith("Description: "))[13:]
        if "broken" in line:
            raise ValueError("cannot read")
        sure = "SEARCH EVIDENCE" in text or "steel" in line
        mapped = "MRO|Valves" if sure else ""
        level = "high" if sure else "low"
        return f'{{"concept_noun": "{line.split(" ")[-1]}", "brand": "skf", "confidence": "{level}", "mapped_category": "{mapped}", "attributes": {{"material": "steel"}}}}'

    return lambda texts: texts.map(answer)


def test_full_run(spark):
    rows = [(1, "steel valve", "A"), (2, "odd valves", "B"), (3, "broken", "A"), (4, "", "A"), (5, "old Valve", "B")]
    items = spark.createDataFrame(rows, "Index long, Description string, Supplier string")
    evidence = spark.createDataFrame([("odd valves", "sold as a valve")], "Description string, evidence string")
    done = run(items, _classifier(), context={"Vendor": "Supplier"}, attributes=["Material"], evidence=evidence)
    out = done.table
    assert [(r["index"], r.error) for r in done.failed.collect()] == [(3, "cannot read")]
    table_ = {r.Index: r for r in out.collect()}
    assert set(table_) == {1, 2, 3, 4, 5} and "Supplier" in out.columns and "Brand_Raw" not in out.columns
    assert (table_[1].Category, table_[1].Classification_Source) == ("MRO|Valves", "AI")
    assert (table_[2].Category, table_[2].Classification_Source) == ("MRO|Valves", "Web")
    assert table_[5].Concept_Noun == table_[1].Concept_Noun == "valve"
    assert table_[1].Material == "steel" and table_[1].Brand == "SKF" and table_[3].Needs_Review == 1


def test_run_keeps_finished_and_prefilled_rows(spark):
    rows = [(1, "steel valve", None), (2, "hex nut", "nut"), (3, "old pump", None), (4, "new pump", None)]
    items = spark.createDataFrame(rows, "Index long, Description string, Concept_Noun_Raw string")
    finished = spark.createDataFrame(
        [(3, "pump", "ACME", "MRO|Pumps", "Web")],
        "Index long, Concept_Noun_Raw string, Brand_Raw string, Final_Category string, Classification_Method string",
    )
    done = run(items, _classifier(), finished=finished)
    got = {r.Index: r for r in done.table.collect()}
    assert set(got) == {1, 2, 3, 4} and sorted(r.Index for r in done.usage.collect()) == [1, 4]
    assert (got[2].Concept_Noun, got[3].Concept_Noun, got[3].Brand, got[3].Category) == ("nut", "pump", "ACME", "MRO|Pumps")
    assert got[3].Classification_Source == "Web" and got[1].Brand == "SKF"
    assert done.stats.first().total_rows == 2 and done.stats.first().failed_rows == 0


def test_run_asks_for_everything_once(spark, tmp_path):
    log = str(tmp_path)

    def classify(texts):
        import os
        import uuid

        import pandas as pd

        for t in texts:
            with open(os.path.join(log, uuid.uuid4().hex), "w") as f:
                f.write(t)
        answer = '{"concept_noun": "valve", "confidence": "medium", "mapped_category": "MRO|None", "attributes": {"lead_time": "3 days"}}'
        return pd.DataFrame({"content": answer, "error": None, "input_tokens": 7, "output_tokens": 2}, index=texts.index)

    items = spark.createDataFrame([(i, f"valve {i}") for i in range(5)], "Index long, Description string")
    evidence = spark.createDataFrame([("valve 1", "seen in a shop")], "Description string, evidence string")
    categories = spark.createDataFrame([("MRO|Valves",), ("MRO|Pumps",)], "category string")
    done = run(
        items, classify, attributes=["Material"], custom={"Lead_Time": {"description": "days until it comes"}}, categories=categories,
        evidence=evidence, evidence_level="medium", tasks=2, model="m",
    )
    rows = done.table.collect()
    sent = [open(os.path.join(log, n)).read() for n in os.listdir(log)]
    assert len(sent) == 6 and all("  - MRO|Pumps\n  - MRO|Valves" in t and "days until it comes" in t and '"material": ""' in t for t in sent)
    assert sum("seen in a shop" in t for t in sent) == 1 and len({r.Lead_Time for r in rows}) == 1 and rows[0].Lead_Time == "3 days"
    assert {(r.Category, r.Proposed_Category) for r in rows} <= {("UNCATEGORIZED", "MRO|None"), ("", "MRO|None")} or all("None" not in (r.Category or "") for r in rows)
    usage = done.usage.groupBy("model").agg(F.sum("input_tokens").alias("i"), F.count("*").alias("n")).first()
    assert (usage.model, usage.i, usage.n) == ("m", 42, 6)
    own = run(items.limit(1), classify, layout="Say: {description}|{template}")
    assert own.table.count() == 1 and any(open(os.path.join(log, n)).read().startswith("Say: valve") for n in os.listdir(log))


def test_saved_mappings_add_up(spark, tmp_path):
    path = str(tmp_path / "maps")
    kind = "value string, canonical string"
    assert load_mapping(spark, path, "noun").count() == 0
    save_mapping(spark.createDataFrame([("a", "x"), ("b", "x")], kind), "noun", path)
    save_mapping(spark.createDataFrame([("b", "y"), ("c", "z")], kind), "noun", path)
    assert sorted(map(tuple, load_mapping(spark, path, "noun").collect())) == [("a", "x"), ("b", "y"), ("c", "z")]


def test_mapping_stream_equals_batch(spark, tmp_path):
    learned = spark.createDataFrame([("Valve", "valve"), ("NUT", "nut")], "value string, canonical string")
    save_mapping(learned, "noun", f"{tmp_path}/maps")
    save_mapping(learned.limit(0), "brand", f"{tmp_path}/maps")
    mapping = load_mapping(spark, f"{tmp_path}/maps", "noun")
    items = spark.createDataFrame([(1, "Valve"), (2, " NUT "), (3, "new"), (4, "")], "Index long, v string")
    items.filter("Index < 3").write.parquet(f"{tmp_path}/in")
    batch = apply_mapping(items, "v", mapping, "o")
    for more in (None, items.filter("Index >= 3")):
        if more is not None:
            more.write.mode("append").parquet(f"{tmp_path}/in")
        stream = apply_mapping_stream(item_stream(spark, f"{tmp_path}/in", items.schema), "v", mapping, "o")
        append_stream(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(got.collect()) == sorted(batch.collect())


def test_resumable_stream_stores_every_key_once(spark, tmp_path):
    items = spark.createDataFrame([(i, f"t{i}") for i in range(6)] + [(None, "t")], "Index long, t string")
    work = lambda df: df.withColumn("u", F.upper("t"))
    for part in (items.filter("Index < 4"), items.filter("Index >= 2 or Index is null")):
        part.write.mode("append").parquet(f"{tmp_path}/in")
        stream = item_stream(spark, f"{tmp_path}/in", items.schema, files_per_batch=1)
        finished = spark.createDataFrame([(0, "old")], "Index long, t string")
        process_stream(stream, work, f"{tmp_path}/out", f"{tmp_path}/state", finished=finished).awaitTermination()
    want = [(None, "T")] + [(i, f"T{i}") for i in range(1, 6)]
    stored = lambda: finished_rows(spark, f"{tmp_path}/out").select("Index", "u").orderBy("Index").collect()
    assert stored() == want
    n = len(os.listdir(tmp_path / "out"))
    assert compact(spark, f"{tmp_path}/out", 1) == n - 1 and sorted(x.split("=")[0] for x in os.listdir(tmp_path / "out")) == ["batch", "upto"]
    assert stored() == want and compact(spark, f"{tmp_path}/out", 1) == 0


def test_batches_do_not_read_what_is_stored(spark, tmp_path):
    """A batch's input is its own file, whatever has been stored: the stored folders may be gone."""
    items = spark.createDataFrame([(i, f"t{i}") for i in range(40)], "Index long, t string")
    read = []
    for part in range(4):
        items.where(F.col("Index") <= 10 * part + 9).where(F.col("Index") >= 10 * part - 2).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = item_stream(spark, f"{tmp_path}/in", items.schema)
        query = process_stream(stream, lambda df: df, f"{tmp_path}/out-{part}", f"{tmp_path}/state")
        query.awaitTermination()
        read += [p.numInputRows for p in query.recentProgress if p.numInputRows]
    assert read == [10, 12, 12, 12]
    assert sum(finished_rows(spark, f"{tmp_path}/out-{part}").count() for part in range(4)) == 40


def test_a_run_that_dies_asks_for_nothing_twice(spark, tmp_path):
    """The third wave kills its job; the second call asks the rows of that wave and of the later ones only."""
    log, store = str(tmp_path / "log"), str(tmp_path / "store")
    os.makedirs(log)
    rows = spark.range(60).select(F.col("id").alias("Index"), F.concat(F.lit("item "), "id").alias("request"))
    waves = {r.Index: r.w for r in rows.select("Index", F.pmod(F.xxhash64("Index"), F.lit(6)).alias("w")).collect()}
    deadly = [f"item {i}" for i, w in waves.items() if w == 2]

    def classifier(kill):
        def classify(texts):
            for t in texts:
                if t in kill:
                    raise SystemExit("the machine is lost")
                with open(os.path.join(log, t), "a") as f:
                    f.write("x")
            return texts.str.upper()

        return classify

    with pytest.raises(Exception):
        ask_in_waves(rows, classifier(deadly), "request", "Index", store, 6, tasks=1)
    asked = set(os.listdir(log))
    assert len(committed(spark, store)) == 2 and asked == {f"item {i}" for i, w in waves.items() if w < 2}
    out = ask_in_waves(rows, classifier([]), "request", "Index", store, 4, tasks=2)
    assert {(r.Index, r.content) for r in out.collect()} == {(i, f"ITEM {i}") for i in range(60)}
    assert all(open(os.path.join(log, f)).read() == "x" for f in os.listdir(log)) and len(os.listdir(log)) == 60
    ask_in_waves(rows, classifier(deadly), "request", "Index", store)  # nothing is left to ask
    changed = ask_in_waves(rows.limit(1).withColumn("request", F.lit("another")), classifier([]), "request", "Index", store)
    assert [r.content for r in changed.collect()] == ["ANOTHER"]


def test_errors_are_asked_again_on_demand(spark, tmp_path):
    rows = spark.createDataFrame([(1, "good"), (2, "bad")], "Index long, request string")

    def classifier(fails):
        def classify(texts):
            if fails and "bad" in set(texts):
                raise ValueError("busy")
            return texts.str.upper()

        return classify

    ask = lambda fails, **more: sorted(map(tuple, ask_in_waves(rows, classifier(fails), "request", "Index", str(tmp_path), 2, **more).select("Index", "content", "error").collect()))
    assert ask(True) == [(1, "GOOD", None), (2, None, "busy")] == ask(False)
    assert ask(True, retry_errors=True) == [(1, "GOOD", None), (2, None, "busy")]
    assert ask(False, retry_errors=True) == [(1, "GOOD", None), (2, "BAD", None)]
    assert ask_in_waves(rows.where("false"), classifier(True), "request", "Index", str(tmp_path)).count() == 0


def test_full_run_over_a_store(spark, tmp_path):
    """Waves, repeated keys in ``finished`` and the nearest category of the taxonomy."""
    items = spark.createDataFrame([(i, f"steel valve {i}") for i in range(8)], "Index long, Description string")
    finished = spark.createDataFrame([(3, "pump"), (3, "pump"), (3, "motor")], "Index long, Concept_Noun_Raw string")
    categories = spark.createDataFrame([("MRO|Valve",), ("MRO|Pumps",)], "category string")
    for waves in (3, 2):
        done = run(items, _classifier(), finished=finished, categories=categories, store=str(tmp_path), waves=waves, taxonomy_threshold=0.9)
        assert sorted(r["Index"] for r in done.usage.collect()) == [0, 1, 2, 4, 5, 6, 7]
    got = {r.Index: (r.Category, r.Concept_Noun) for r in done.table.collect()}
    assert len(got) == done.table.count() == 8 and got[0][0] == "MRO|Valve" and got[3][1] in ("pump", "motor")


def test_enrich_keeps_every_call(spark):
    """Thousands of calls of one request: nulls, failures, token counts and order of the answers."""
    import pandas as pd

    from itemnorm.operators.enrich import enrich

    def answer(texts):
        text = texts.iloc[0]
        if len(texts) > 1 or text.endswith("3"):
            raise ValueError(f"no {text}")
        if text.endswith("4"):
            return texts.str.upper()
        return pd.DataFrame({"content": [f"<{text}>"], "input_tokens": [len(text)], "error": [None], "other": [1]})

    df = spark.range(0, 10_000, 1, 1).selectExpr("id", "if(id % 10 = 9, null, concat('t', id)) as r")
    rows = {r.id: r for r in enrich(df, answer, "r", ["id", "r"], around=("a ", " b")).collect()}
    assert len(rows) == 10_000
    assert all(rows[i].content == f"<a t{i} b>" and rows[i].input_tokens == len(f"a t{i} b") for i in (0, 5, 9_997))
    assert all(r.output_tokens is None for r in rows.values())
    assert rows[9].error and rows[9].content is None and rows[9].r is None

    df = df.selectExpr("id", "concat('t', id) as r")
    rows = {r.id: r for r in enrich(df, answer, "r", ["id"]).collect()}
    assert rows[3].error == "no t3" and rows[3].content is None and rows[4].content == "T4" and rows[4].input_tokens is None
    numbers = enrich(df.where("id < 20"), answer, "id", ["id"]).collect()
    assert len(numbers) == 20 and all(r.error and r.content is None for r in numbers)
    halves = enrich(df.where("id < 20"), lambda texts: texts + "!", "r", ["id"], batch=3).collect()
    assert sorted((r.id, r.content) for r in halves) == [(i, f"t{i}!") for i in range(20)]
    with pytest.raises(Exception, match="another number of answers"):
        enrich(df.where("id < 20"), lambda texts: texts.iloc[:1], "r", ["id"], batch=3).collect()


def test_enrich_builds_one_table_a_batch_of_rows(spark):
    """Not one a call: that took most of the time of ``failed_rows``. The calls count the tables joined so far."""
    from itemnorm.operators.enrich import enrich

    def answer(texts):
        import pandas as pd

        if not hasattr(pd, "joined"):
            join, pd.joined = pd.concat, []
            pd.concat = lambda *a, **b: pd.joined.append(1) or join(*a, **b)
        return texts.map(lambda text: str(len(pd.joined)))

    calls = enrich(spark.range(0, 200, 1, 1).selectExpr("id", "concat('t', id) as r"), answer, "r", ["id"]).collect()
    counts = [int(r.content) for r in sorted(calls)]
    assert counts[-1] - counts[0] == 0
