"""Classification level by level: the frontier of items goes down the taxonomy, and what is settled leaves it.

Each round asks every item of the frontier for one child of the path it has reached, with the children as the list to choose
from. The answers of a round are a written table, so a round is never asked again. An item leaves the frontier at a leaf,
with an answer that is no child of its path (which becomes its proposal), or with an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.enrich import LEVEL_REQUEST, enrich, parse_level_response, request_text
from ..operators.taxonomy import level_options, taxonomy_children
from ..session import cut, work_folder


def level_loop(
    items: DataFrame, classify: Callable, categories: DataFrame, order: str = "Index", description: str = "Description",
    tasks: int | None = None, batch: int = 1,
) -> DataFrame:
    """(order, path, level, proposed, error) of every item: the path chosen, the number of its levels, the answer that is
    no category, if any, and what went wrong, if anything. The path of an item that stops is what it had reached.

    Blank categories are no part of the taxonomy; without one, every item keeps the empty path."""
    folder = work_folder(items.sparkSession)
    held = categories.where("category is not null and category <> ''")
    options = cut(level_options(held), folder, "options")
    steps = cut(taxonomy_children(held).select("parent", "child", "leaf"), folder, "steps")
    start = items.select(order, F.col(description).alias("description"), F.lit("").alias("path"), F.lit(False).alias("leaf"))
    frontier, done, level = cut(start, folder, "level0"), [], 0
    none = F.lit(None).cast("string")
    while True:
        asked = frontier.where("not leaf").join(options, F.col("path") == F.col("parent")).drop("parent")
        lists = asked.withColumn("request", request_text("description", categories=F.col("options"), layout=LEVEL_REQUEST, level=level + 1))
        settled = frontier.join(asked.select(order), order, "left_anti")
        done.append(settled.select(order, "path", F.lit(level).alias("level"), none.alias("proposed"), none.alias("error")))
        if asked.isEmpty():
            break
        level += 1
        answers = cut(enrich(lists, classify, "request", [order, "description", "path"], tasks, batch), folder, f"answers{level}")
        chosen = answers.withColumn("chosen", parse_level_response("content")["selected_category"])
        found = chosen.join(steps.withColumnRenamed("leaf", "ends"), (F.col("path") == F.col("parent")) & (F.col("chosen") == F.col("child")), "left")
        longer = F.when(F.col("path") == "", F.col("child")).otherwise(F.concat("path", F.lit("|"), "child"))
        found = cut(found.withColumn("longer", longer), folder, f"found{level}")
        lost = found.where("child is null")
        done.append(lost.select(order, "path", F.lit(level - 1).alias("level"), F.nullif("chosen", F.lit("")).alias("proposed"), "error"))
        on = found.where("child is not null").select(order, "description", F.col("longer").alias("path"), F.col("ends").alias("leaf"))
        frontier = cut(on, folder, f"level{level}")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
