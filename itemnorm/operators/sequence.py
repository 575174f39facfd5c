"""Sequence ratio (Ratcliff/Obershelp) of pairs of texts, as DataFrame rounds.

The ratio is twice the number of matched characters over the length of both texts. Matched are the longest common run,
the first one in the left text and then in the right one, and then, in the same way, what lies before it in both texts and what lies behind it.

A row is a pair with its characters, the characters matched so far and its open segments: the stretches of both texts
that still have to be compared. A step finds the longest run of every open segment by dynamic programming over arrays and puts up to
two smaller segments in its place. The steps need no shuffle. After ``STEPS`` of them the rows are written, and pairs whose
matched characters and open segments together no longer reach the threshold are left out; so most pairs cost one
round, and only pairs that are really near go on until no segment is open.

In a right text of ``LONG`` characters or more, characters that fill over a hundredth of it begin no run; a run goes on
over them on both sides. This is the usual rule of that ratio and makes it, as does the order of ties, not symmetric.
Two empty texts have the ratio 1, null texts have none and their pairs are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, work_folder

LONG = 200
STEPS = 3

#: SQL for the first longest run of the segment ``g`` of the arrays x and y: named_struct(k, i, j), i and j from the
#: beginning of the segment. ``p`` holds the length of the run that ends at each place of y and the last place of x.
_RUN = """transform(array(slice(y, g.yl + 1, g.yh - g.yl)), ys -> aggregate(slice(x, g.xl + 1, g.xh - g.xl),
    named_struct('p', CAST(array() AS array<int>), 'n', 0, 'k', 0, 'i', 0, 'j', 0),
    (s, c) -> transform(array(transform(ys, (d, j) -> if(c = d AND NOT array_contains(common, d), coalesce(get(s.p, j - 1), 0) + 1, 0))), p ->
      transform(array(array_max(p)), top -> named_struct('p', p, 'n', s.n + 1, 'k', greatest(s.k, top),
        'i', if(top > s.k, s.n + 1 - top, s.i), 'j', if(top > s.k, CAST(array_position(p, top) AS int) - top, s.j)))[0])[0],
    s -> named_struct('k', s.k, 'i', s.i, 'j', s.j)))[0]"""


def _alike(a: str, b: str) -> str:
    """SQL for the number of elements that two arrays begin with alike."""
    first = f"array_position(zip_with({a}, {b}, (v, w) -> v <=> w AND v IS NOT NULL), false)"
    return f"CAST(if({first} = 0, least(size({a}), size({b})), {first} - 1) AS int)"


#: SQL for the run ``r`` of a segment, in places of the whole texts, made longer on both sides where common characters agree.
_BEFORE = _alike("reverse(slice(x, g.xl + 1, r.i))", "reverse(slice(y, g.yl + 1, r.j))")
_BEHIND = _alike("slice(x, g.xl + r.i + r.k + 1, g.xh - g.xl - r.i - r.k)", "slice(y, g.yl + r.j + r.k + 1, g.yh - g.yl - r.j - r.k)")
_GROWN = f"""transform(array(if(size(common) = 0, named_struct('b', 0, 'e', 0), named_struct('b', {_BEFORE}, 'e', {_BEHIND}))),
    t -> named_struct('xl', g.xl, 'xh', g.xh, 'yl', g.yl, 'yh', g.yh, 'k', r.k + t.b + t.e, 'i', g.xl + r.i - t.b, 'j', g.yl + r.j - t.b))[0]"""
_FOUND = f"transform(open, g -> transform(array({_RUN}), r -> {_GROWN})[0])"
_OPEN = """flatten(transform(filter(found, f -> f.k > 0), f -> filter(array(
    named_struct('xl', f.xl, 'xh', f.i, 'yl', f.yl, 'yh', f.j),
    named_struct('xl', f.i + f.k, 'xh', f.xh, 'yl', f.j + f.k, 'yh', f.yh)), g -> g.xh > g.xl AND g.yh > g.yl)))"""
_MATCHED = "aggregate(found, matched, (t, f) -> t + f.k)"
_HOPE = "aggregate(open, matched, (t, g) -> t + least(g.xh - g.xl, g.yh - g.yl))"


def _ratio(matched: Column) -> Column:
    total = F.size("x") + F.size("y")
    return F.when(total == 0, 1.0).otherwise(matched * F.lit(2.0) / total)


def _step(rows: DataFrame) -> DataFrame:
    keys = ["a", "b", "x", "y", "common"]
    # a generator, as projections are not merged through it: else the runs would be searched once per use
    found = rows.select(*keys, "matched", F.explode(F.array(F.expr(_FOUND))).alias("found"))
    return found.select(*keys, F.expr(_MATCHED).alias("matched"), F.expr(_OPEN).alias("open"))


def sequence_ratios(pairs: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(a, b, similarity) of the pairs (a, b, left, right) whose ratio reaches the threshold."""
    folder = work_folder(pairs.sparkSession)
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    rows = pairs.where(F.col("left").isNotNull() & F.col("right").isNotNull())
    rows = rows.select("a", "b", chars("left").alias("x"), chars("right").alias("y"))
    often = "filter(array_distinct(y), c -> size(filter(y, d -> d = c)) > size(y) div 100 + 1)"
    common = F.when(F.size("y") >= LONG, F.expr(often)).otherwise(F.array().cast("array<string>"))
    whole = "filter(array(named_struct('xl', 0, 'xh', size(x), 'yl', 0, 'yh', size(y))), g -> g.xh > 0 AND g.yh > 0)"
    rows = rows.select("*", common.alias("common"), F.lit(0).alias("matched"), F.expr(whole).alias("open"))
    done, turn = None, 0
    while True:
        for _ in range(STEPS):
            rows = _step(rows)
        rows = cut(rows.where(_ratio(F.expr(_HOPE)) >= threshold), folder, f"round{turn}")
        settled = rows.where(F.size("open") == 0).select("a", "b", _ratio(F.col("matched")).alias("similarity"))
        done = settled if done is None else done.unionByName(settled)
        rows, turn = rows.where(F.size("open") > 0), turn + 1
        if rows.isEmpty():
            return done
