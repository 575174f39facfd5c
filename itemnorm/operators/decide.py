"""Merging two sources, the category decision, descriptions, scores and the output table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE_RUN, as_col, blank, clean_brand, first_present, let, strip

# Attributes of a description, in this order.
DESCRIPTION_ATTRIBUTES = [
    "size_primary", "size_secondary", "size_unit",
    "material", "material_grade", "color",
    "thread_type", "pressure_rating", "temperature_rating",
    "voltage", "power", "weight", "certification",
    "quantity_per_pack",
]
# The columns the standard run feeds into a description.
DESCRIPTION_COLUMNS = {
    "size_primary": "Size_Primary",
    "material": "Material",
    "material_grade": "Material_Grade",
    "color": "Color",
    "thread_type": "Thread_Type",
}
# Words that never serve as key terms, and the marks cut off the ends of a word.
COMMON_WORDS = ["the", "a", "an", "and", "or", "for", "to", "of", "in", "on", "at", "by", "with"]
WORD_MARKS = ".,;:()[]{}\"'-"
# Base score per confidence.
BASE_SCORE = {"high": 85, "medium": 65, "low": 45}
REVIEW_BELOW = 70
NO_CATEGORY = "UNCATEGORIZED"

# Leading columns of the output table.
ESSENTIAL_COLUMNS = [
    "Index", "Description", "Language", "Translated_Description", "Brand", "Concept_Noun", "Modifier",
    "Category_Type", "Is_Product_or_Service", "Service_Object", "AI_Insight", "AI_Confidence",
    "Category", "Proposed_Category", "Classification_Source",
]
# Attribute columns of the output table.
OUTPUT_ATTRIBUTES = [
    "Material", "Size_Dimension", "UOM", "Thread_Type", "Pressure_Rating", "Temperature_Rating",
    "Voltage", "Power", "Quantity_Per_Pack", "Packaging", "Model", "Processor", "RAM", "Storage",
    "Screen_Size", "Software", "Service_Type", "Duration", "Scope", "Other",
]
SCORE_COLUMNS = ["Normalized_Description", "Confidence_Score", "Needs_Review"]
# Name parts of intermediate columns.
INTERMEDIATE = ["_Raw", "Web_", "Final_", "Mapped_Category", "Matching_Reason", "Classification_Method"]


def merge_sources(df: DataFrame, output: str, web: str, ai: str) -> DataFrame:
    """The web value where it is not blank, else the first answer, else the empty string. A source
    column that the table lacks counts as blank."""
    there = [c for c in (web, ai) if c in df.columns]
    return df.withColumn(output, first_present(*there) if there else F.lit(""))


def final_category(ai_confidence: str, ai_mapped: str, ai_proposed: str, web_confidence: str, web_mapped: str, web_proposed: str) -> Column:
    """Struct (category, proposed, method). A matched category goes before a proposed one: web if surely
    matched, then the first answer unless its confidence is low, then any web match."""
    filled = lambda c: ~blank(c)
    web = F.lower(F.coalesce(as_col(web_confidence), F.lit("")))
    ai = F.lower(F.coalesce(as_col(ai_confidence), F.lit("low")))
    proposal = F.coalesce(
        F.when(filled(ai_proposed), as_col(ai_proposed)),
        F.when(filled(web_proposed), as_col(web_proposed)),
        F.lit(NO_CATEGORY),
    )

    def result(category: Column, proposed: Column, method: Column) -> Column:
        return F.struct(category.alias("category"), proposed.alias("proposed"), method.alias("method"))

    none = F.lit("")
    method = F.when(proposal == NO_CATEGORY, F.lit("No Match")).otherwise(F.lit("Proposed"))
    return (
        F.when((web == "high") & filled(web_mapped), result(as_col(web_mapped), none, F.lit("Web")))
        .when(ai.isin("high", "medium") & filled(ai_mapped), result(as_col(ai_mapped), none, F.lit("AI")))
        .when(filled(web_mapped), result(as_col(web_mapped), none, F.lit("Web")))
        .otherwise(result(none, proposal, method))
    )


def normalized_description(
    noun: Column | str, text: Column | str, brand: Column | str, modifier: Column | str, attributes: list[Column | str]
) -> Column:
    """``noun - modifier ; brand ; attributes``. Attributes in the given order and, while there are
    fewer than three parts, up to three longer words of the text are added unless already present."""
    none = F.array().cast("array<string>")
    kept = lambda c: F.when(blank(c), F.lit("")).otherwise(F.lower(as_col(c)))
    lowered = F.lower(F.coalesce(as_col(text), F.lit("")))
    modifiers = F.filter(F.transform(F.split(kept(modifier), ","), strip), lambda m: m != "")
    start = F.concat(
        F.array(F.lower(as_col(noun))),
        modifiers,
        F.filter(F.array(kept(brand)), lambda b: b != ""),
    )
    add_new = lambda parts, v: F.when(F.array_contains(parts, v), parts).otherwise(F.array_append(parts, v))
    values = F.filter(F.array(*[kept(a) for a in attributes]), lambda v: v != "") if attributes else none
    with_attributes = F.aggregate(values, start, add_new)

    def with_terms(parts: Column) -> Column:
        words = F.transform(F.split(lowered, SPACE_RUN), lambda w: F.btrim(w, F.lit(WORD_MARKS)))
        terms = F.filter(
            words, lambda w: (F.length(w) > 3) & ~w.isin(COMMON_WORDS) & ~F.array_contains(parts, w)
        )
        return F.when(F.size(parts) < 3, F.aggregate(F.slice(terms, 1, 3), parts, add_new)).otherwise(parts)

    def write(parts: Column) -> Column:
        head = F.element_at(parts, 1)
        tail = F.array_join(F.slice(parts, F.lit(2), F.size(parts)), " ; ")
        return F.when(F.size(parts) > 1, F.concat(head, F.lit(" - "), tail)).otherwise(head)

    described = let(let(with_attributes, with_terms), write)
    return F.when(blank(noun), lowered).otherwise(described)


def confidence_score(confidence: str, brand: str, mapped: str, noun: str, category_type: str, description: str) -> Column:
    """Score 0..100 of how far a row can be trusted."""
    level = F.lower(F.coalesce(as_col(confidence), F.lit("low")))
    base = F.lit(BASE_SCORE["low"])
    for name in ("medium", "high"):
        base = F.when(level == name, F.lit(BASE_SCORE[name])).otherwise(base)
    gain = lambda c, points: F.when(blank(c), F.lit(0)).otherwise(F.lit(points))
    score = (
        base
        + gain(brand, 5)
        + gain(mapped, 5)
        + F.when(blank(noun), F.lit(-15)).otherwise(F.lit(5))
        + gain(category_type, 3)
        + F.when(F.length(F.coalesce(as_col(description), F.lit(""))) < 10, F.lit(-10)).otherwise(F.lit(0))
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), score))


def needs_review(score: Column | str, below: int = REVIEW_BELOW) -> Column:
    return F.when(as_col(score) < below, F.lit(1)).otherwise(F.lit(0))


def output_column_list(columns: list[str]) -> list[str]:
    """Essentials, attributes, scores, then the input's own columns without intermediate ones."""
    lead = [c for c in ESSENTIAL_COLUMNS + OUTPUT_ATTRIBUTES + SCORE_COLUMNS if c in columns]
    return lead + [c for c in columns if c not in lead and not any(part in c for part in INTERMEDIATE)]


def select_output(df: DataFrame) -> DataFrame:
    """Final names and columns: a proposed category shows only where there is no category."""
    out = df
    if "Final_Category" in df.columns:
        final = F.coalesce("Final_Category", F.lit(""))
        out = out.withColumn("Category", final)
        if "Final_Proposed_Category" in df.columns:
            proposed = F.coalesce("Final_Proposed_Category", F.lit(""))
            out = out.withColumn("Proposed_Category", F.when(blank(final), proposed).otherwise(F.lit("")))
        if "Classification_Method" in df.columns:
            out = out.withColumn("Classification_Source", F.col("Classification_Method"))
    if "Brand" in df.columns:
        out = out.withColumn("Brand", clean_brand("Brand"))
    return out.select(*output_column_list(out.columns))
