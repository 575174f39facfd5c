"""Value clustering: counts, key collisions, canonical forms and the column normalizer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import (
    blank,
    character_bag,
    clean_brand_suffix,
    clean_category_type,
    key_fingerprint,
    ngram_fingerprint,
    ngrams,
    singularize,
    strip,
)
from ..session import cut, work_folder
from .similarity import (
    greedy_leaders,
    jaccard_verify,
    sequence_token_threshold,
    sequence_verify,
    similar_pairs,
)

KINDS = ("noun", "category", "brand", "generic")
#: Shared keys that are sent to every task; with more, all variants are shuffled by their key.
SENT = 1_000_000


def value_counts(df: DataFrame, column: str, order: str) -> DataFrame:
    """``(value, n, first_pos)`` of the stripped non-blank values."""
    return (
        df.filter(~blank(column))
        .groupBy(strip(column).alias("value"))
        .agg(F.count("*").alias("n"), F.min(order).alias("first_pos"))
    )


def exact_counts(df: DataFrame, column: str, order: str) -> DataFrame:
    """``(value, n, first_pos)`` of the non-null values as they stand."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count("*").alias("n"), F.min(order).alias("first_pos"))
    )


# --- key collision ------------------------------------------------------------------------------


def collision_clusters(
    df: DataFrame, column: str, order: str, method: str = "fingerprint", n: int = 2
) -> DataFrame:
    """``(cluster_key, value, n, first_pos, variants)``, one row per variant of every cluster with two
    variants or more.

    Hashes of keys are counted first, so that only variants whose hash comes twice are shuffled with their texts."""
    if method not in ("fingerprint", "ngram"):
        raise ValueError(f"unknown method {method!r}")
    key = key_fingerprint("value") if method == "fingerprint" else ngram_fingerprint("value", n)
    folder = work_folder(df.sparkSession)
    keyed = exact_counts(df, column, order).withColumn("cluster_key", key)
    keyed = cut(keyed.withColumn("h", F.expr("if(cluster_key <> '', xxhash64(cluster_key), null)")), folder, "keyed").filter("h is not null")
    twice = cut(keyed.groupBy("h").agg(F.count("*").alias("m")).filter("m >= 2").select("h"), folder, "twice")
    if twice.count() <= SENT:
        keyed = keyed.join(F.broadcast(twice), "h", "left_semi")
    return _only_shared(keyed)


def _only_shared(variants: DataFrame) -> DataFrame:
    sizes = variants.groupBy("cluster_key").agg(F.count("*").alias("variants")).filter("variants >= 2")
    return variants.join(sizes, "cluster_key").select("cluster_key", "value", "n", "first_pos", "variants")


# --- similarity ---------------------------------------------------------------------------------


def ngram_nodes(keys: DataFrame, key: str, order: str, n: int = 2, unicode_ngrams: bool = False) -> tuple[DataFrame, DataFrame]:
    """Collapse keys with the same n-gram set into one node.

    Returns the keys with their ``gram_key`` and the nodes ``(node, gram_key, tokens, text)``; ``node`` is
    the earliest position and ``text`` the key at it. Keys with no n-gram take no part."""
    folder = work_folder(keys.sparkSession)
    grams = ngrams(key, n, unicode_ngrams)
    marked = keys.filter(F.col(key) != "").withColumn("tokens", F.array_sort(grams))
    marked = marked.withColumn("gram_key", F.array_join("tokens", ""))
    nodes = marked.groupBy("gram_key").agg(
        F.min(order).alias("node"), F.any_value("tokens").alias("tokens"), F.min_by(key, order).alias("text")
    )
    return marked.drop("tokens"), cut(nodes, folder, "nodes")


def ngram_similar_pairs(keys: DataFrame, key: str, order: str, threshold: float = 0.85, n: int = 2, unicode_ngrams: bool = False) -> DataFrame:
    """Pairs ``(left_key, right_key, similarity)`` of distinct n-gram sets, earlier key first."""
    _, nodes = ngram_nodes(keys, key, order, n, unicode_ngrams)
    pairs = similar_pairs(nodes, threshold, jaccard_verify(nodes, threshold), grid=True)
    return _named_pairs(pairs, nodes)


def _named_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    left = nodes.select(F.col("node").alias("a"), F.col("text").alias("left_key"))
    right = nodes.select(F.col("node").alias("b"), F.col("text").alias("right_key"))
    return pairs.join(left, "a").join(right, "b").select("left_key", "right_key", "similarity")


def leader_clusters(keys: DataFrame, key: str, order: str, threshold: float = 0.85, n: int = 2, unicode_ngrams: bool = False, **tuning) -> DataFrame:
    """``(key, position, cluster)`` for every key: ``cluster`` is the position of its leader."""
    marked, nodes = ngram_nodes(keys, key, order, n, unicode_ngrams)
    led = greedy_leaders(nodes, threshold, jaccard_verify(nodes, threshold), grid=True, **tuning)
    of_gram = nodes.select("gram_key", "node").join(led, "node").select("gram_key", "leader")
    of_key = marked.join(of_gram, "gram_key").select(key, F.col(order).alias("position"), F.col("leader").alias("cluster"))
    # Keys without any n-gram stay alone.
    rest = keys.filter(F.col(key) == "").select(key, F.col(order).alias("position"), F.col(order).alias("cluster"))
    return of_key.unionByName(rest)


def _text_nodes(df: DataFrame, column: str, order: str) -> tuple[DataFrame, DataFrame]:
    folder = work_folder(df.sparkSession)
    values = cut(exact_counts(df, column, order).withColumn("text", F.lower("value")), folder, "values")
    nodes = values.groupBy("text").agg(F.min("first_pos").alias("node"), F.min_by("value", "first_pos").alias("value"))
    return values, cut(nodes.withColumn("tokens", character_bag("text")), folder, "nodes")


def fuzzy_similar_pairs(df: DataFrame, column: str, order: str, threshold: float = 0.8) -> DataFrame:
    """Pairs ``(left_key, right_key, similarity)`` of values, distinct in lower case, whose sequence ratio
    reaches the threshold."""
    _, nodes = _text_nodes(df, column, order)
    pairs = similar_pairs(nodes, threshold, sequence_verify(nodes, threshold), sequence_token_threshold(threshold))
    return _named_pairs(pairs, nodes.select("node", F.col("value").alias("text")))


def fuzzy_clusters(df: DataFrame, column: str, order: str, threshold: float = 0.8, **tuning) -> DataFrame:
    """As :func:`collision_clusters`; ``cluster_key`` is the value of the leader."""
    values, nodes = _text_nodes(df, column, order)
    led = greedy_leaders(
        nodes, threshold, sequence_verify(nodes, threshold), sequence_token_threshold(threshold), **tuning
    )
    leader_value = nodes.select(F.col("node").alias("leader"), F.col("value").alias("cluster_key"))
    of_text = nodes.select("node", "text").join(led, "node").join(leader_value, "leader").select("text", "cluster_key")
    return _only_shared(values.join(of_text, "text"))


# --- canonical form -----------------------------------------------------------------------------


def canonical_value(value: str = "value", n: str = "n", *order: str) -> Column:
    """Aggregate: most frequent, then lower-case, then shortest, then earliest value, in lower case."""
    v = F.col(value)
    rank = F.struct(F.col(n), v == F.lower(v), -F.length(v), *[-F.col(o) for o in order])
    return F.lower(F.max_by(v, rank))


def type_rule(kind: str, canonical: Column, compat: bool = True) -> Column:
    if kind == "noun":
        return singularize(F.lower(canonical))
    if kind == "category":
        return clean_category_type(canonical)
    if kind == "brand":
        return clean_brand_suffix(canonical, compat)
    return canonical


@dataclass(frozen=True)
class Normalized:
    """Result of the column normalizer: ``mapping(value, canonical)`` keyed by the stripped value."""

    mapping: DataFrame
    kind: str

    def summary(self) -> DataFrame:
        """One row: distinct canonical forms and how many distinct lower-case values were merged."""
        return self.mapping.agg(
            F.count_distinct("canonical").alias("unique_values"),
            F.greatest(
                F.lit(0), F.count_distinct(F.lower("value")) - F.count_distinct("canonical")
            ).alias("clustered"),
        )


def normalize_column(
    df: DataFrame,
    column: str,
    order: str,
    kind: str = "generic",
    threshold: float = 0.85,
    n: int = 2,
    unicode_ngrams: bool = False,
    brand_compat: bool = True,
    **tuning,
) -> Normalized:
    """Count values, collapse equal fingerprints, merge near keys under leaders, choose a canonical form.

    All work is on distinct values; the table itself is only scanned once here."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    folder = work_folder(df.sparkSession)
    counts = cut(value_counts(df, column, order).withColumn("key", key_fingerprint("value")), folder, "values")
    if counts.count() <= 1:
        # A single value keeps its case unless a type rule lowers it.
        mapping = counts.select("value", type_rule(kind, F.col("value"), brand_compat).alias("canonical"))
        return Normalized(mapping, kind)
    keys = counts.groupBy("key").agg(F.min("first_pos").alias("key_pos"))
    clusters = leader_clusters(keys, "key", "key_pos", threshold, n, unicode_ngrams, **tuning)
    clustered = counts.join(clusters, "key").select("value", "n", "first_pos", "position", "cluster")
    # Within a cluster the leader's own values come first, then those of each absorbed key in turn.
    forms = clustered.groupBy("cluster").agg(canonical_value("value", "n", "position", "first_pos").alias("canonical"))
    mapping = clustered.join(forms, "cluster").select("value", type_rule(kind, F.col("canonical"), brand_compat).alias("canonical"))
    return Normalized(cut(mapping, folder, "mapping"), kind)


def apply_mapping(df: DataFrame, column: str, mapping: DataFrame, output: str, keep_blank: bool = False) -> DataFrame:
    """Left-join a ``(value, canonical)`` mapping onto a column by its stripped value. Unmatched values keep
    themselves; blanks become the empty string, or stay as they are with ``keep_blank``.

    The planner broadcasts a small mapping; a large one is shuffled and adaptive execution splits hot values."""
    found = mapping.select(F.col("value").alias("_value"), F.col("canonical").alias("_canonical"))
    c = F.col(column)
    joined = df.join(found, F.when(~blank(c), strip(c)) == F.col("_value"), "left")
    empty = c if keep_blank else F.lit("")
    return joined.withColumn(
        output, F.when(blank(c), empty).otherwise(F.coalesce(F.col("_canonical"), c))
    ).drop("_value", "_canonical")
