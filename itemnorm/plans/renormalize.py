"""Normalization, descriptions and scoring of an enriched table, and the full run around it."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.clustering import Normalized, apply_mapping, normalize_column
from ..operators.consensus import apply_consensus
from ..operators.decide import (
    DESCRIPTION_ATTRIBUTES,
    DESCRIPTION_COLUMNS,
    confidence_score,
    final_category,
    merge_sources,
    needs_review,
    normalized_description,
    select_output,
)
from ..operators.enrich import (
    CATEGORY_HEAD,
    FIRST_REQUEST,
    RESPONSE_COLUMNS,
    WEB_COLUMNS,
    attribute_key,
    context_text,
    enrich,
    flatten_response,
    json_template,
    needs_evidence,
    parse_response,
    request_text,
    require_columns,
    resume_pending,
    rows_to_enrich,
    shared_parts,
)
from ..operators.report import run_stats
from ..operators.taxonomy import category_list_text, nearest_category, validate_category
from ..sources.catalog import attribute_catalog, attribute_section
from ..session import cut, work_folder
from .waves import ask_in_waves


@dataclass(frozen=True)
class Result:
    table: DataFrame
    normalized: dict[str, Normalized]


def _with_blank_columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({n: F.lit("") for n in names if n not in df.columns})


def normalize(df: DataFrame, order: str = "Index", threshold: float = 0.85, n: int = 2, unicode_ngrams: bool = False, **tuning) -> Result:
    """Merge both sources, normalize noun, category type and modifier, and vote categories."""
    df = _with_blank_columns(df, [*RESPONSE_COLUMNS.values(), "Final_Category"])
    for output, web, ai in (
        ("Concept_Noun", "Web_Concept_Noun", "Concept_Noun_Raw"),
        ("Category_Type", "Web_Category_Type", "Category_Type_Raw"),
        ("Modifier", "Web_Modifier", "Modifier_Raw"),
    ):
        df = merge_sources(df, output, web, ai)
    kinds = {"Concept_Noun": "noun", "Category_Type": "category", "Modifier": "generic"}

    def one(column: str) -> Normalized:
        return normalize_column(df, column, order, kinds[column], threshold, n, unicode_ngrams, **tuning)

    # The columns are independent, so their small jobs share the cluster instead of waiting in line.
    with ThreadPoolExecutor(len(kinds)) as pool:
        tasks = {c: pool.submit(inheritable_thread_target(df.sparkSession)(one), c) for c in kinds}
        normalized = {c: task.result() for c, task in tasks.items()}
    for column, result in normalized.items():
        df = apply_mapping(df, column, result.mapping, column)
    # Brands keep their own spelling: clustering would ruin short codes.
    df = df.withColumns(
        {
            "Brand": F.upper(strip(F.coalesce("Brand_Raw", F.lit("")))),
            "Mapped_Category": F.col("Mapped_Category_Raw"),
            "Proposed_Category": F.col("Proposed_Category_Raw"),
        }
    )
    return Result(apply_consensus(df, ["Final_Category", "Mapped_Category"]), normalized)


def describe(df: DataFrame) -> DataFrame:
    """Add the normalized description, the confidence score and the review flag."""
    text = F.coalesce(F.nullif("Translated_Description", F.lit("")), "Description")
    attributes = [
        F.col(DESCRIPTION_COLUMNS[a])
        for a in DESCRIPTION_ATTRIBUTES
        if a in DESCRIPTION_COLUMNS and DESCRIPTION_COLUMNS[a] in df.columns
    ]
    score = confidence_score(
        "AI_Confidence", "Brand", "Mapped_Category", "Concept_Noun", "Category_Type", "Description"
    )
    return df.withColumns(
        {
            "Normalized_Description": normalized_description("Concept_Noun", text, "Brand", "Modifier", attributes),
            "Confidence_Score": score,
        }
    ).withColumn("Needs_Review", needs_review("Confidence_Score"))


def renormalize(checkpoint: DataFrame, order: str = "Index", threshold: float = 0.85, **options) -> Result:
    """Normalize, describe and score a stored table again."""
    result = normalize(require_columns(checkpoint, "Description", order), order, threshold, **options)
    return Result(describe(result.table), result.normalized)


def decide(df: DataFrame) -> DataFrame:
    """Final category, proposal and method from the two sources."""
    decision = final_category(
        "AI_Confidence",
        "Mapped_Category_Raw",
        "Proposed_Category_Raw",
        "Web_Confidence",
        "Web_Mapped_Category",
        "Web_Proposed_Category",
    )
    decided = df.withColumn("_decision", decision)
    return decided.withColumns(
        {
            "Final_Category": F.col("_decision.category"),
            "Final_Proposed_Category": F.col("_decision.proposed"),
            "Classification_Method": F.col("_decision.method"),
        }
    ).drop("_decision")


@dataclass(frozen=True)
class Run:
    """``table``: the output; ``failed``: rows without an answer; ``usage``: one row per call with its tokens, for
    ``cost.usage_cost``; ``normalized``: learned mappings, for ``save_mapping``; ``stats``: one row of counts."""

    table: DataFrame
    failed: DataFrame
    usage: DataFrame
    normalized: dict[str, Normalized]
    stats: DataFrame


def _stored(items: DataFrame, todo: DataFrame, finished: DataFrame | None, order: str) -> DataFrame:
    """The items that are not asked, with what is stored about them: in ``finished``, else in their own columns."""
    rest = items.join(todo.select(order), order, "left_anti")
    if finished is None:
        return rest
    known = [c for c in finished.columns if c != order]
    cells = F.struct(*known) if known else F.struct(F.lit(True))
    once = finished.groupBy(order).agg(F.min_by(cells, F.to_json(cells)).alias("_cells"))  # a key counts once
    marked = once.select(order, "_cells.*").select(order, *[F.col(c).alias(f"_stored_{c}") for c in known], F.lit(True).alias("_stored"))
    joined = rest.join(marked, order, "left")
    cells = {c: F.when(F.col("_stored"), F.col(f"_stored_{c}")).otherwise(F.col(c) if c in rest.columns else F.lit(None)) for c in known}
    return joined.withColumns(cells).select(*dict.fromkeys([*rest.columns, *known]))


def _in_taxonomy(df: DataFrame, mapped: str, proposed: str, categories: DataFrame, threshold: float | None = None) -> DataFrame:
    """A mapped category that the taxonomy does not hold becomes its nearest one, if a threshold is given and one reaches
    it, and else the proposal, unless there is one."""
    if threshold is not None:
        near = nearest_category(df, mapped, categories, threshold, "_nearest")
        df = near.withColumn(mapped, F.coalesce("_nearest", mapped)).select(*df.columns)
    checked = validate_category(df.withColumn("_mapped", F.col(mapped)), "_mapped", categories)
    moved = F.coalesce(F.nullif(F.col(proposed), F.lit("")), "proposed_category")
    return checked.withColumns({mapped: F.col("valid_category"), proposed: moved}).select(*df.columns)


def run(
    items: DataFrame,
    classify: Callable,
    order: str = "Index",
    context: dict[str, str] | None = None,
    attributes: list[str] | None = None,
    evidence: DataFrame | None = None,
    finished: DataFrame | None = None,
    tasks: int | None = None,
    categories: DataFrame | None = None,
    custom: dict[str, dict[str, str]] | None = None,
    layout: str = FIRST_REQUEST,
    evidence_level: str = "low",
    batch: int = 1,
    model: str = "",
    store: str | None = None,
    waves: int = 16,
    taxonomy_threshold: float | None = None,
    **options,
) -> Run:
    """Full run: ask, parse, ask again with evidence, decide, normalize, describe.

    ``evidence`` is ``(Description, evidence)``, used for answers up to ``evidence_level`` of confidence.
    ``finished`` holds rows of an earlier run; they and the items that have a noun already are not asked and keep
    what is stored. ``categories`` is the taxonomy; with ``taxonomy_threshold``, a category that it lacks becomes its nearest one of at
    least that similarity, if there is one; ``attributes`` and ``custom`` name what to ask for besides the
    fixed fields; ``layout`` may be the caller's own request. The answers are written once to the shared folder, so
    a lost executor never repeats a call. With ``store``, a folder of the caller's, they are committed in ``waves``, and a run that
    died is called again with the same store: it asks only what has no committed answer."""
    require_columns(items, "Description", order)
    spark = items.sparkSession
    folder = work_folder(spark)
    todo = rows_to_enrich(items)
    if finished is not None:
        todo = resume_pending(todo, finished, order)
    shown = context_text({name: F.col(c) for name, c in (context or {}).items()}) if context else None
    names = list(dict.fromkeys([*(attributes or []), *(n.strip().replace(" ", "_") for n in custom or {})]))
    section = ""
    if names:
        chosen = spark.createDataFrame([("run", n) for n in names], "set string, name string")
        row = attribute_section(chosen, attribute_catalog(spark, custom), "set").first()
        section = "\n" + row.section + "\n" if row else ""
    listed = CATEGORY_HEAD + category_list_text(categories) + "\n" if categories is not None else ""
    template = json_template([attribute_key(n) for n in names], categories is not None)
    parts = {"categories": listed, "attributes": section, "template": template}
    before, row_layout, after = shared_parts(layout, parts)

    def ask(rows: DataFrame, name: str, extra=None) -> DataFrame:
        asked = rows.withColumn("_request", request_text("Description", shown, extra, layout=row_layout))
        if store is None:
            return cut(enrich(asked, classify, "_request", [order], tasks, batch, (before, after)), folder, name)
        found = ask_in_waves(asked, classify, "_request", order, f"{store.rstrip('/')}/{name}", waves, tasks, batch, (before, after))
        return cut(found, folder, name)

    first = ask(todo, "answers")
    parsed = todo.join(first, order, "left").withColumn("_parsed", parse_response("content"))
    answered = flatten_response(parsed, "_parsed", names).drop("_parsed", "content", "input_tokens", "output_tokens")
    calls = first
    if evidence is not None:
        unsure = answered.filter(F.col("error").isNull() & needs_evidence("AI_Confidence", level=evidence_level))
        unsure = unsure.select(order, "Description", *(context or {}).values()).join(evidence, "Description")
        second = ask(unsure.filter("evidence <> ''"), "answers2", F.col("evidence"))
        calls = calls.unionByName(second)
        web = second.filter("error is null").withColumn("_parsed", parse_response("content"))
        web = flatten_response(web, "_parsed", web=True).select(order, *WEB_COLUMNS.values())
        answered = answered.drop(*WEB_COLUMNS.values()).join(web, order, "left")
    answered = _with_blank_columns(answered, list(WEB_COLUMNS.values())).drop("error")
    if categories is not None:
        answered = _in_taxonomy(answered, "Mapped_Category_Raw", "Proposed_Category_Raw", categories, taxonomy_threshold)
        answered = _in_taxonomy(answered, "Web_Mapped_Category", "Web_Proposed_Category", categories, taxonomy_threshold)
    failed = items.select(order, "Description").join(first.filter("error is not null"), order)
    kept = _with_blank_columns(_stored(items, todo, finished, order), [*RESPONSE_COLUMNS.values(), *WEB_COLUMNS.values(), *names])
    decisions = ["Final_Category", "Final_Proposed_Category", "Classification_Method"]
    stored = {c: F.col(c) if c in kept.columns else F.lit(None).cast("string") for c in decisions}
    kept = decide(kept.withColumns({f"_{c}": x for c, x in stored.items()}))
    kept = kept.withColumns({c: F.coalesce(f"_{c}", c) for c in decisions}).drop(*[f"_{c}" for c in decisions])
    every = decide(answered).unionByName(kept, allowMissingColumns=True)
    # The decided rows are the stored checkpoint from which everything after can be run again.
    decided = cut(every, folder, "decided")
    result = renormalize(decided, order, **options)
    usage = calls.select(
        F.lit(model).alias("model"), F.lit(None).cast("string").alias("provider"), order, "input_tokens", "output_tokens", "error"
    )
    return Run(
        select_output(result.table),
        failed.select(F.col(order).alias("index"), F.substring("Description", 1, 100).alias("description"), "error"),
        usage,
        result.normalized,
        run_stats(first, {c.lower(): n.summary() for c, n in result.normalized.items()}),
    )
