"""Filters, metrics, profiles and benchmarking tables over the final result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import as_col, blank
from .ordering import first_per_group

# Labels of confidence levels.
CONFIDENCE_LABELS = {"high": "🟢 High", "medium": "🟡 Medium", "low": "🔴 Low", "none": "⚫ None"}


def filter_results(
    df: DataFrame,
    confidence: list[str] | None = None,
    kinds: list[str] | None = None,
    review: bool | None = None,
    category_types: list[str] | None = None,
    search: str | None = None,
) -> DataFrame:
    """Rows that pass all given filters; ``search`` is a pattern looked for in any case."""
    out = df
    if confidence is not None:
        out = out.filter(F.lower("AI_Confidence").isin(confidence))
    if kinds is not None:
        out = out.filter(F.col("Is_Product_or_Service").isin(kinds))
    if review is not None:
        out = out.filter(F.col("Needs_Review") == int(review))
    if category_types is not None:
        out = out.filter(F.col("Category_Type").isin(category_types))
    if search:
        out = out.filter(F.col("Description").rlike(f"(?iu){search}"))
    return out


def drill_down(df: DataFrame, selection: DataFrame, column: str = "Normalized_Description") -> DataFrame:
    """Rows of the selected values of a column."""
    return df.join(selection.select(column), column, "left_semi")


def benchmark_items(df: DataFrame, order: str, brands: int = 3, top: int | None = 20) -> DataFrame:
    """Per normalized description: rows, first distinct brands in order, first noun; most frequent first."""
    key = "Normalized_Description"
    keyed = df.filter(F.col(key).isNotNull())
    noun = F.when(F.col("Concept_Noun").isNotNull(), F.struct(F.col(order).alias("at"), F.col("Concept_Noun").alias("noun")))
    # One pass over the table; both results below come from its small rows.
    counted = keyed.groupBy(key, "Brand").agg(
        F.count("Description").alias("_n"), F.min(order).alias("_pos"), F.min(noun).alias("_noun")
    )
    totals = counted.groupBy(key).agg(F.sum("_n").alias("Count"), F.min("_noun")["noun"].alias("Concept_Noun"))
    per_brand = counted.filter(F.col("Brand").isNotNull())
    first = first_per_group(per_brand, [key], [F.col("_pos")], brands, "_rank")
    listed = first.groupBy(key).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("_rank", "Brand"))), lambda b: b["Brand"]), ", "
        ).alias("Brands")
    )
    out = totals.join(listed, key, "left").select(key, "Count", F.coalesce("Brands", F.lit("")).alias("Brands"), "Concept_Noun")
    ranked = out.orderBy(F.desc("Count"), key)
    return ranked if top is None else ranked.limit(top)


def attribute_top_values(df: DataFrame, attributes: list[str], top: int = 20) -> DataFrame:
    """``(attribute, value, count, rank)``: the most frequent non-blank values of every attribute."""
    long = df.select(*attributes).unpivot([], attributes, "attribute", "value")
    counts = long.filter(~blank("value")).groupBy("attribute", "value").agg(F.count("*").alias("count"))
    return first_per_group(counts, ["attribute"], [F.desc("count"), F.col("value")], top)


def result_metrics(df: DataFrame) -> DataFrame:
    """One row of counts over the result."""
    level = F.lower("AI_Confidence")
    return df.agg(
        F.count("*").alias("total"),
        *[F.count_if(level == name).alias(f"{name}_confidence") for name in ("high", "medium", "low")],
        *[F.count_if(F.col("Is_Product_or_Service") == k).alias(f"{k.lower()}s") for k in ("Product", "Service")],
        F.count_if(F.col("Needs_Review") == 1).alias("needs_review"),
    )


def confidence_breakdown(df: DataFrame, confidence: str = "AI_Confidence") -> DataFrame:
    """Rows per confidence level with its label."""
    return (
        df.groupBy(F.lower(F.coalesce(confidence, F.lit("none"))).alias("level"))
        .agg(F.count("*").alias("rows"))
        .withColumn("label", confidence_label("level"))
    )


def column_profile(df: DataFrame, columns: list[str], order: str, samples: int = 3, approximate: bool = False) -> DataFrame:
    """``(column, non_null, nulls, distinct_values, samples)``; samples are the first distinct values.

    One pass counts each value per column; ``approximate`` replaces the exact distinct counts by sketches."""
    text = [F.col(c).cast("string").alias(c) for c in columns]
    long = df.select(F.col(order).alias("_pos"), *text).unpivot("_pos", columns, "column", "value")
    per_value = long.groupBy("column", "value").agg(F.count("*").alias("n"), F.min("_pos").alias("_pos"))
    present = F.col("value").isNotNull()
    filled = F.when(present, F.col("n")).otherwise(F.lit(0))
    if approximate:
        totals = long.groupBy("column").agg(
            F.count("value").alias("non_null"),
            F.count_if(~present).alias("nulls"),
            F.approx_count_distinct("value").alias("distinct_values"),
        )
    else:
        totals = per_value.groupBy("column").agg(
            F.sum(filled).alias("non_null"),
            F.sum(F.col("n") - filled).alias("nulls"),
            F.count("value").alias("distinct_values"),
        )
    first = first_per_group(per_value.filter(present), ["column"], [F.col("_pos"), F.col("value")], samples, "_rank")
    listed = first.groupBy("column").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("_rank", "value"))), lambda s: s["value"]), " | "
        ).alias("samples")
    )
    return totals.join(listed, "column", "left").withColumn("samples", F.coalesce("samples", F.lit("")))


def run_stats(enriched: DataFrame, summaries: dict[str, DataFrame]) -> DataFrame:
    """One row: rows, failed rows, and the normalizer summary of each named column.

    Every input is a one-row aggregate, read as a scalar."""
    totals = enriched.agg(
        F.count("*").alias("total_rows"), F.count_if(F.col("error").isNotNull()).alias("failed_rows")
    )
    for name, summary in summaries.items():
        totals = totals.withColumns(
            {
                f"unique_{name}": summary.select("unique_values").scalar(),
                f"{name}_clustered": summary.select("clustered").scalar(),
            }
        )
    return totals


def confidence_label(c: Column | str) -> Column:
    c = as_col(c)
    label = c
    for level, text in CONFIDENCE_LABELS.items():
        label = F.when(F.lower(c) == level, F.lit(text)).otherwise(label)
    return label


# Twice a power of ten as a falling sum of powers of two: each product below is exact.
EXACT_STEPS = {0: (2,), 1: (16, 4), 2: (128, 64, 8)}


def fixed_text(x: Column | str, digits: int) -> Column:
    """A non-negative double with 0 to 2 decimals, rounded by its exact value and half to even, as C's printf
    does. ``format_string`` rounds the shortest decimal form half up instead."""
    x = as_col(x)
    scale = 10**digits
    k = F.floor(x * scale)
    first, *others = EXACT_STEPS[digits]
    # The sign of x minus the middle between k and k+1; no step of the sum rounds near the middle.
    above = x * first - (k * 2 + 1)
    for step in others:
        above = above + x * step
    up = F.when(above > 0, F.lit(1)).when(above < 0, F.lit(0)).otherwise(k % 2)
    n = k + up
    if digits == 0:
        return n.cast("string")
    return F.concat(F.floor(n / scale).cast("string"), F.lit("."), F.lpad((n % scale).cast("string"), digits, "0"))


def duration_text(seconds: Column | str) -> Column:
    s = as_col(seconds)
    return (
        F.when(s < 60, F.concat(fixed_text(s, 0), F.lit("s")))
        .when(s < 3600, F.concat(fixed_text(s / 60, 1), F.lit(" min")))
        .otherwise(F.concat(fixed_text(s / 3600, 1), F.lit(" hours")))
    )
