"""Propose clusters for a human to review, and apply the decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_category_type, singularize_review, strip
from .ordering import paged_text

# Columns that hold a normalized result.
NORMALIZED_COLUMNS = ["Concept_Noun", "Category_Type", "Modifier", "Final_Category", "Brand"]


def cluster_review(clusters: DataFrame, approve: bool = True, page_size: int = 1000) -> DataFrame:
    """Review table of clusters in variant form ``(cluster_key, value, n, first_pos)``.

    ``variants`` lists the values by count; the most frequent is the proposed canonical form. Clusters
    with more than ``page_size`` variants continue on further pages."""
    totals = clusters.groupBy("cluster_key").agg(
        F.max_by("value", F.struct(F.col("n"), -F.col("first_pos"))).alias("normalize_to"),
        F.count("*").alias("variant_count"),
        F.sum("n").alias("total_rows"),
    )
    texts = paged_text(
        clusters,
        "cluster_key",
        [-F.col("n"), F.col("first_pos")],
        F.format_string("%s (%d)", "value", "n"),
        " | ",
        page_size,
    )
    return (
        texts.join(totals, "cluster_key")
        .select(
            "cluster_key",
            F.lit(approve).alias("approve"),
            "page",
            F.col("text").alias("variants"),
            "normalize_to",
            F.lit("").alias("exclude"),
            "variant_count",
            "total_rows",
        )
        .orderBy(F.desc("variant_count"), "cluster_key", "page")
    )


def reviewed_form(column: str, canonical: Column) -> Column:
    """Rule that the name of the column asks for."""
    if "Concept_Noun" in column:
        return singularize_review(F.lower(canonical))
    if "Category_Type" in column:
        return clean_category_type(canonical)
    return canonical


def joint_decisions(decisions: DataFrame, proposals: DataFrame) -> DataFrame:
    """``(cluster_key, to, conflict)``: what all pages of a cluster say together.

    A cluster is approved if none of its pages withdraws approval. Its value is the one that a page sets other
    than the proposal ``(cluster_key, proposed)``, else the proposal. Pages that set different values
    contradict each other: ``conflict`` is true and nothing is decided."""
    said = decisions.join(proposals, "cluster_key", "left")
    edited = F.when(~F.col("normalize_to").eqNullSafe(F.col("proposed")), F.col("normalize_to"))
    joint = said.groupBy("cluster_key").agg(
        F.every(F.coalesce("approve", F.lit(False))).alias("approved"),
        F.min(edited).alias("low"),
        F.max(edited).alias("high"),
        F.min("proposed").alias("proposed"),
    )
    return joint.filter("approved").select(
        "cluster_key",
        F.coalesce("low", "proposed").alias("to"),
        F.coalesce(F.col("low") != F.col("high"), F.lit(False)).alias("conflict"),
    )


def review_proposals(clusters: DataFrame) -> DataFrame:
    """``(cluster_key, proposed)``: the most frequent variant, which the review table proposes."""
    return clusters.groupBy("cluster_key").agg(
        F.max_by("value", F.struct(F.col("n"), -F.col("first_pos"))).alias("proposed")
    )


def review_conflicts(clusters: DataFrame, decisions: DataFrame) -> DataFrame:
    """Keys of approved clusters whose pages set different values; they are left as they are."""
    return joint_decisions(decisions, review_proposals(clusters)).filter("conflict").select("cluster_key")


def review_mapping(column: str, clusters: DataFrame, decisions: DataFrame) -> DataFrame:
    """``(value, canonical)`` from approved decisions ``(cluster_key, approve, normalize_to, exclude)``, leaving
    out the variants listed in ``exclude`` (separated by semicolons or commas) on any page of the cluster."""
    chosen = joint_decisions(decisions, review_proposals(clusters)).filter("not conflict")
    listed = decisions.select("cluster_key", F.explode(F.split("exclude", "[;,]")).alias("value"))
    excluded = listed.select("cluster_key", strip("value").alias("value")).filter("value <> ''").distinct()
    joined = clusters.join(excluded, ["cluster_key", "value"], "left_anti").join(chosen, "cluster_key")
    joined = joined.withColumn("canonical", reviewed_form(column, F.col("to")))
    return joined.filter(F.col("value") != F.col("canonical")).select("value", "canonical")


def apply_review(df: DataFrame, column: str, clusters: DataFrame, decisions: DataFrame) -> DataFrame:
    """Replace the reviewed values, all at once and never in a chain; other values stay."""
    mapping = review_mapping(column, clusters, decisions).select(
        F.col("value").alias("_value"), F.col("canonical").alias("_canonical")
    )
    joined = df.join(mapping, F.col(column) == F.col("_value"), "left")
    return joined.withColumn(column, F.coalesce("_canonical", column)).select(*df.columns)


def change_counts(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``(column, changed)``: cells that differ between two versions of a table."""
    old = before.select(key, *[F.col(c).alias(f"old_{c}") for c in columns])
    both = after.select(key, *columns).join(old, key)
    counted = both.agg(*[F.count_if(~F.col(c).eqNullSafe(F.col(f"old_{c}"))).alias(c) for c in columns])
    return counted.unpivot([], columns, "column", "changed")


def export_columns(columns: list[str], choice: str = "standard") -> list[str]:
    """Columns to export: ``minimal`` (normalized), ``standard`` (without raw and web ones) or ``full``."""
    normalized = [c for c in columns if c in NORMALIZED_COLUMNS]
    raw = [c for c in columns if "_Raw" in c or c.startswith("Web_")]
    if choice == "minimal":
        return normalized
    if choice == "standard":
        return normalized + [c for c in columns if c not in normalized and c not in raw]
    if choice == "full":
        return list(columns)
    raise ValueError("choice must be minimal, standard or full")


def export(df: DataFrame, choice: str = "standard") -> DataFrame:
    return df.select(*export_columns(df.columns, choice))
