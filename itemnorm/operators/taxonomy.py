"""Category paths: levels, children, validation, keywords and attribute sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import as_col, blank, character_bag, strip
from ..session import cut, work_folder
from ..sources.catalog import DEFAULT_SET
from .ordering import with_position
from .sequence import sequence_ratios
from .similarity import candidates, sequence_token_threshold, signatures

# Keywords wanted per category, and the share that is enough.
KEYWORD_TARGET = 15
KEYWORD_ENOUGH = 0.8
# Fixed value: how near a category of the taxonomy must be to stand for one that it lacks.
FUZZY_THRESHOLD = 0.9
#: The longest category list that is put into a request, in characters.
REQUEST_CHARS = 4_000_000


def taxonomy_levels(categories: DataFrame) -> DataFrame:
    """``(level, parent, child, last)`` once per distinct edge; the parent is the path above the child and
    ``last`` tells whether some path ends there."""
    parts = F.split("category", r"\|")
    steps = categories.select("category", F.size(parts).alias("depth"), F.posexplode(parts).alias("i", "child"))
    edges = steps.select(
        (F.col("i") + 1).alias("level"),
        F.array_join(F.slice(F.split("category", r"\|"), F.lit(1), F.col("i")), "|").alias("parent"),
        "child",
        (F.col("i") + 1 == F.col("depth")).alias("last"),
    )
    return edges.groupBy("level", "parent", "child").agg(F.bool_or("last").alias("last"))


def taxonomy_children(categories: DataFrame) -> DataFrame:
    """Every edge with the number of children below it. ``leaf`` marks an end: no children, or a single
    one that repeats its parent's name."""
    levels = taxonomy_levels(categories)
    below = levels.groupBy(F.col("parent").alias("path")).agg(
        F.count("*").alias("children"), F.min("child").alias("only_child")
    )
    path = F.when(F.col("parent") == "", F.col("child")).otherwise(F.concat("parent", F.lit("|"), "child"))
    joined = levels.withColumn("path", path).join(below, "path", "left")
    children = F.coalesce("children", F.lit(0).cast("long"))
    return joined.select(
        "level",
        "parent",
        "child",
        children.alias("children"),
        ((children == 0) | ((children == 1) & (F.col("only_child") == F.col("child")))).alias("leaf"),
    )


def taxonomy_summary(categories: DataFrame) -> DataFrame:
    parts = F.split("category", r"\|")
    return categories.agg(
        F.count("*").alias("categories"),
        F.count_distinct(F.element_at(parts, 1)).alias("level1"),
        F.max(F.size(parts)).alias("depth"),
    )


def category_pages(categories: DataFrame, page_size: int = 500) -> DataFrame:
    """``(page, options)``: the lines of the category list in alphabetical order, ``page_size`` distinct categories a page.

    Positions come from a range sort, so no task sees more than its part of the list, and a group is one page. Nulls
    are left out; without categories there is no page."""
    held = categories.select("category").where("category is not null").distinct()
    placed = with_position(held, ["category"], "_at", start=0)
    page = F.floor(F.col("_at") / page_size).cast("long").alias("page")
    lines = F.array_sort(F.collect_list(F.struct("_at", F.concat(F.lit("  - "), "category").alias("line"))))
    return placed.groupBy(page).agg(F.array_join(lines["line"], "\n").alias("options"))


def category_list_text(categories: DataFrame, limit: int = REQUEST_CHARS) -> str:
    """The lines of the category list, in order. The whole list is the part of a request that all rows share:
    it is read once and handed to the classifier beside the rows, never written into them.

    As it goes into every request, it cannot be longer than one: a list of more than ``limit`` characters, counted
    before anything is read, is refused. Such a taxonomy is asked level by level (``plans.levels``), which never
    reads a list whole."""
    pages = cut(category_pages(categories), work_folder(categories.sparkSession), "category-pages")
    size = pages.agg(F.coalesce(F.sum(F.length("options") + 1), F.lit(0))).first()[0]
    if size > limit + 1:
        raise ValueError(f"the category list has {size - 1} characters, over the {limit} of a request; ask level by level (plans.levels.level_loop)")
    return "\n".join(r.options for r in pages.orderBy("page").toLocalIterator())


def level_options(categories: DataFrame) -> DataFrame:
    """``(parent, options)``: the lines of the children below every path, for a level request."""
    edges = taxonomy_levels(categories)
    lines = F.array_sort(F.collect_list(F.concat(F.lit("  - "), "child")))
    return edges.groupBy("parent").agg(F.array_join(lines, "\n").alias("options"))


def attach_level_options(items: DataFrame, chosen: str, categories: DataFrame) -> DataFrame:
    """Add ``options``, the categories below the path chosen so far; empty at a leaf."""
    options = level_options(categories).select(F.col("parent").alias("_parent"), "options")
    joined = items.join(options, F.col(chosen) == F.col("_parent"), "left")
    return joined.withColumn("options", F.coalesce("options", F.lit(""))).drop("_parent")


def validate_category(items: DataFrame, category: str, categories: DataFrame) -> DataFrame:
    """Keep a category that the taxonomy holds exactly; move any other to ``proposed_category``."""
    valid = categories.select(F.col("category").alias("_valid")).distinct()
    joined = items.join(valid, F.col(category) == F.col("_valid"), "left")
    given = F.coalesce(F.col(category), F.lit(""))
    return joined.withColumns(
        {
            "valid_category": F.coalesce("_valid", F.lit("")),
            "proposed_category": F.when(F.col("_valid").isNull(), given).otherwise(F.lit("")),
        }
    ).drop("_valid")


def nearest_category(
    items: DataFrame, category: str, categories: DataFrame, threshold: float = FUZZY_THRESHOLD, nearest: str = "nearest_category",
    similarity: str | None = None,
) -> DataFrame:
    """Add the category of the taxonomy that resembles the given one most, by the sequence ratio of the lower-case texts.

    A category that the taxonomy holds is its own nearest one, with 1; one that none reaches the threshold for, or that is blank,
    has null. Equal ratios go to the alphabetically first category. Only distinct texts that the taxonomy lacks are compared: they meet its texts
    through the signatures of their characters, both sides split where a signature is hot."""
    folder = work_folder(items.sparkSession)
    held = categories.select(F.col("category").alias("category")).where("category is not null").distinct()
    asked = items.select(F.col(category).alias("asked")).where(~blank(category)).distinct()
    asked = asked.join(held, F.col("asked") == F.col("category"), "left_anti")
    number = lambda df, c, sign: with_position(df, [c], "at").select(
        (F.col("at") * sign).alias("node"), F.col(c).alias("value"), F.lower(c).alias("text"), character_bag(c).alias("tokens")
    )
    theirs, ours = cut(number(held, "category", -1), folder, "held"), cut(number(asked, "asked", 1), folder, "asked")
    bag = sequence_token_threshold(threshold)
    signed = [cut(signatures(df, bag), folder, f"{name}-signed") for df, name in ((theirs, "held"), (ours, "asked"))]
    pairs = candidates(*signed, bag, folder=folder, name="nearest")
    texts = pairs.join(ours.select(F.col("node").alias("b"), F.col("text").alias("left")), "b")
    texts = texts.join(theirs.select(F.col("node").alias("a"), F.col("text").alias("right")), "a")
    scored = sequence_ratios(texts, threshold).join(theirs.select(F.col("node").alias("a"), "value"), "a")
    best = scored.groupBy("b").agg(F.min(F.struct((-F.col("similarity")).alias("far"), "value")).alias("best"))
    found = ours.join(best, F.col("node") == F.col("b")).select(
        F.col("value").alias("_asked"), F.col("best.value").alias("_near"), (-F.col("best.far")).alias("_ratio")
    )
    found = found.unionByName(held.select(F.col("category").alias("_asked"), F.col("category").alias("_near"), F.lit(1.0).alias("_ratio")))
    joined = items.join(found, F.col(category) == F.col("_asked"), "left").withColumn(nearest, F.col("_near"))
    joined = joined.withColumn(similarity, F.col("_ratio")) if similarity else joined
    return joined.drop("_asked", "_near", "_ratio")


def keyword_distribution(categories: DataFrame, keywords: DataFrame, target: int = KEYWORD_TARGET) -> DataFrame:
    """Keywords per category of the taxonomy, 0 where there are none."""
    counts = keywords.groupBy("category").agg(F.count("*").alias("_n"))
    current = F.coalesce("_n", F.lit(0).cast("long"))
    return categories.join(counts, "category", "left").select(
        "category",
        current.alias("current"),
        F.lit(target).alias("target"),
        F.when(current >= target * KEYWORD_ENOUGH, F.lit("ok")).otherwise(F.lit("low")).alias("status"),
    )


def attach_attribute_set(items: DataFrame, category: str, mapping: DataFrame, sets: DataFrame, default: list[str] | None = None) -> DataFrame:
    """Add ``attribute_set`` and the list ``attributes`` by the first level of the category.

    ``mapping`` is ``(Level1_Category, Attribute_Set)``, ``sets`` the long form of the sets. A set has
    eight attributes at most, so its list is small."""
    lists = sets.groupBy("attribute_set").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "attribute"))).alias("_slots")
    )
    named = mapping.select(
        strip("Level1_Category").alias("_level1"), strip("Attribute_Set").alias("attribute_set")
    ).join(lists, "attribute_set")
    level1 = F.element_at(F.split(F.coalesce(as_col(category), F.lit("")), r"\|"), 1)
    joined = items.withColumn("_l1", level1).join(named, F.col("_l1") == F.col("_level1"), "left")
    fallback = F.array(*[F.lit(a) for a in (default or DEFAULT_SET)])
    return joined.withColumns(
        {
            "attribute_set": F.coalesce("attribute_set", F.lit("Default_Set")),
            "attributes": F.coalesce(F.transform("_slots", lambda s: s["attribute"]), fallback),
        }
    ).drop("_l1", "_level1", "_slots")
