"""Category voting inside clusters of like items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, key_fingerprint, strip
from .ordering import paged_text
from .review import joint_decisions


def item_key(noun: str = "Concept_Noun", modifier: str = "Modifier", category_type: str = "Category_Type") -> Column:
    """Noun, and the fingerprint of the modifier or, where that is empty, of the category type."""
    by_modifier = key_fingerprint(modifier)
    detail = F.coalesce(F.nullif(by_modifier, F.lit("")), key_fingerprint(category_type))
    return F.concat(strip(F.lower(F.coalesce(F.col(noun), F.lit("")))), F.lit("|"), detail)


def chosen_key(columns: list[str]) -> Column:
    """First column stripped and lower-case, the others as fingerprints, joined by a bar."""
    first, *others = [F.coalesce(F.col(c), F.lit("")) for c in columns]
    return F.concat_ws("|", strip(F.lower(first)), *[key_fingerprint(c) for c in others])


def tally(df: DataFrame, key: str, category: str) -> DataFrame:
    """``(key, category, n)``: rows per category value in a cluster; null counts as empty.

    Combines map-side, so a hot cluster arrives as one row per category and task."""
    value = F.coalesce(F.col(category), F.lit(""))
    return df.groupBy(key, value.alias("category")).agg(F.count("*").alias("n"))


def votes(tallies: DataFrame, key: str) -> DataFrame:
    """``(key, winner, votes, voters, rows, variants)`` per cluster of two rows or more that has a
    category at all. Blank cells count as rows but do not vote."""
    vote = F.when(~blank("category"), F.col("n"))
    return (
        tallies.groupBy(key)
        .agg(
            F.max_by("category", vote).alias("winner"),
            F.max(vote).alias("votes"),
            F.sum(vote).alias("voters"),
            F.sum("n").alias("rows"),
            F.count(vote).alias("variants"),
        )
        .filter("rows >= 2 and voters > 0")
    )


def consensus(tallies: DataFrame, key: str) -> DataFrame:
    """The clusters in which more than half of the votes agree."""
    return votes(tallies, key).filter("votes * 2 > voters")


def apply_consensus(df: DataFrame, columns: list[str], key_column: Column | None = None) -> DataFrame:
    """Give every row of an agreeing cluster its winning category, blanks included, for each column."""
    keyed = df.withColumn("_key", key_column if key_column is not None else item_key())
    # One pass over the table counts all columns together; the votes work on that small table.
    joint = keyed.groupBy("_key", *columns).agg(F.count("*").alias("_n"))
    winners = None
    for i, c in enumerate(columns):
        value = F.coalesce(F.col(c), F.lit(""))
        tallies = joint.groupBy("_key", value.alias("category")).agg(F.sum("_n").alias("n"))
        found = consensus(tallies, "_key").select("_key", F.col("winner").alias(f"_winner{i}"))
        winners = found if winners is None else winners.join(found, "_key", "full")
    # The table itself is joined once, whatever the number of columns.
    out = keyed.join(winners, "_key", "left")
    out = out.withColumns({c: F.coalesce(f"_winner{i}", c) for i, c in enumerate(columns)})
    return out.select(*df.columns)


def category_clusters(df: DataFrame, key_columns: list[str], category: str) -> DataFrame:
    """``(cluster_key, canonical, variants, total_rows)`` of agreeing clusters over chosen columns."""
    keyed = df.withColumn("cluster_key", chosen_key(key_columns))
    agreed = consensus(tally(keyed, "cluster_key", category), "cluster_key")
    return agreed.select(
        "cluster_key", F.col("winner").alias("canonical"), "variants", F.col("rows").alias("total_rows")
    )


def category_review(df: DataFrame, key_columns: list[str], category: str, order: str, page_size: int = 1000) -> DataFrame:
    """Review table of the agreeing clusters that hold more than one category. ``variants`` lists every
    value with its count, the blank one too; ``clustering_key`` shows the key columns of the first row."""
    keyed = df.withColumn("cluster_key", chosen_key(key_columns))
    value = F.coalesce(F.col(category), F.lit(""))
    counted = keyed.groupBy("cluster_key", value.alias("category")).agg(
        F.count("*").alias("n"), F.min(order).alias("first_pos")
    )
    shown = F.concat_ws(" + ", *[F.coalesce(F.col(c), F.lit("")) for c in key_columns])
    heads = keyed.groupBy("cluster_key").agg(F.min_by(shown, order).alias("clustering_key"))
    open_clusters = consensus(counted, "cluster_key").filter("variants > 1")
    texts = paged_text(
        counted.join(open_clusters.select("cluster_key"), "cluster_key", "left_semi"),
        "cluster_key",
        [-F.col("n"), F.col("first_pos")],
        F.format_string("%s (%d)", "category", "n"),
        " ⚫ ",
        page_size,
    )
    return (
        texts.join(open_clusters, "cluster_key")
        .join(heads, "cluster_key")
        .select(
            "cluster_key",
            F.lit(True).alias("approve"),
            "clustering_key",
            "page",
            F.col("text").alias("variants"),
            F.col("winner").alias("normalize_to"),
            F.col("rows").alias("total_rows"),
        )
        .orderBy(F.desc("total_rows"), "cluster_key", "page")
    )


def apply_category_decisions(df: DataFrame, key_columns: list[str], category: str, decisions: DataFrame) -> DataFrame:
    """Set the category of all rows of the approved clusters. ``decisions`` is a review table,
    ``(cluster_key, approve, normalize_to)``, possibly edited; all pages of a cluster decide together, and
    clusters whose pages contradict each other stay as they are (see ``review.joint_decisions``)."""
    keyed = df.withColumn("_key", chosen_key(key_columns))
    agreed = consensus(tally(keyed, "_key", category), "_key")
    proposals = agreed.select(F.col("_key").alias("cluster_key"), F.col("winner").alias("proposed"))
    chosen = joint_decisions(decisions, proposals).filter("not conflict")
    chosen = chosen.select(F.col("cluster_key").alias("_key"), F.col("to").alias("_to"))
    return keyed.join(chosen, "_key", "left").withColumn(category, F.coalesce("_to", category)).select(*df.columns)
