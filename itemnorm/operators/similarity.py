"""Exact set-similarity joins and greedy leader clustering.

Nodes are rows ``(node, tokens, ...)``: ``node`` is a unique long that gives the order, ``tokens`` an
array of distinct strings. Two nodes are near when the Jaccard similarity of their token sets
reaches the threshold.

Candidates come from partition signatures (Arasu et al., VLDB 2006; Deng et al., VLDB 2016). If the
smaller of two near sets has l tokens, at most H = (1-t)/t * l tokens differ, so when the token
universe is hashed into H+1 parts the two sets agree completely on one part or more. One
equi-join on (level, part, signature of the part) finds every near pair, and each signature stands for
several tokens at once, which selects far better than one shared token. ``level`` is a band of set
sizes; near sets lie in the same or in neighbouring bands.

Sizes and a 256-bit parity sketch (its Hamming distance never exceeds the number of
differing tokens) are compared inside the join, so that a pair that cannot be near is never written.

Over a small universe, as that of letter bigrams, a part tells so little that the join meets a tenth of all pairs. There
the sketches alone are compared, one row a node and all pairs whose sizes allow it (``grid_candidates``): more pairs, but
each much cheaper than a joined row, and a node is sent to the cells of its blocks instead of once per part.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import set_similarity
from ..session import cut, work_folder
from .sequence import sequence_ratios

log = logging.getLogger(__name__)

SKETCH_WORDS = 4
SIGNATURE = ["level", "part", "signature"]
TINY = 1e-9
# Nodes of a block of the grid, and blocks at most while a block stays under its most nodes.
BLOCK, BLOCKS, MOST_IN_BLOCK = 32_768, 40, 1_000_000
# Rounds after which the members found so far become one table, to keep the plan short.
COMPACT_EVERY = 16

Verify = Callable[[DataFrame], DataFrame]


def _log_step(threshold: float) -> float:
    # A little wider than 1/t, so that rounding cannot put near sets two bands apart.
    return math.log(1.0 / threshold) + 1e-6


def _parts_of_level(level: Column, threshold: float) -> Column:
    largest = F.exp((level + 1) * F.lit(_log_step(threshold))) * (1 + TINY)
    return (F.floor(largest * ((1 - threshold) / threshold) + TINY) + 1).cast("int")


def _sketch_word(hashes: str, k: int) -> Column:
    def flip(word: Column, h: Column) -> Column:
        slot = F.pmod(h, F.lit(64 * SKETCH_WORDS)).cast("int")
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot % 64)
        here = F.floor(slot / 64) == k
        return word.bitwiseXOR(F.when(here, bit).otherwise(F.lit(0).cast("long")))

    return F.aggregate(hashes, F.lit(0).cast("long"), flip)


def sketches(nodes: DataFrame) -> DataFrame:
    """``(node, size, w0..w3)`` of the nodes with tokens."""
    hashed = nodes.filter(F.size("tokens") > 0).select(
        "node", F.size("tokens").alias("size"), F.transform("tokens", lambda t: F.xxhash64(t)).alias("hashes")
    )
    return hashed.select("node", "size", *[_sketch_word("hashes", k).alias(f"w{k}") for k in range(SKETCH_WORDS)])


def signatures(nodes: DataFrame, threshold: float) -> DataFrame:
    """One row per node, level and part: ``(node, level, part, signature, own, size, w0..w3)``.

    ``own`` marks the band of the node's own size; the other rows let it meet smaller sets."""
    hashed = nodes.filter(F.size("tokens") > 0).select(
        "node",
        F.size("tokens").alias("size"),
        F.transform("tokens", lambda t: F.xxhash64(t)).alias("hashes"),
    )
    # Dealt by node while a node is one row; the many rows of its parts are then grouped where they are.
    hashed = hashed.repartition("node")
    own_level = F.floor(F.log(F.col("size").cast("double")) / _log_step(threshold)).cast("long")
    sketched = hashed.select(
        "*",
        own_level.alias("own_level"),
        *[_sketch_word("hashes", k).alias(f"w{k}") for k in range(SKETCH_WORDS)],
    )
    levels = sketched.withColumn(
        "level", F.explode(F.array(F.col("own_level"), F.col("own_level") - 1))
    ).filter("level >= 0")
    levels = levels.withColumn("parts", _parts_of_level(F.col("level"), threshold))
    # Two parts without tokens agree as well, so every part gets an entry that changes nothing.
    cells = F.concat(
        F.transform(
            "hashes",
            lambda h: F.struct(F.pmod(F.xxhash64(h), F.col("parts")).cast("int").alias("part"), h.alias("hash")),
        ),
        F.transform(
            F.sequence(F.lit(0), F.col("parts") - 1),
            lambda i: F.struct(i.alias("part"), F.lit(0).cast("long").alias("hash")),
        ),
    )
    words = [f"w{k}" for k in range(SKETCH_WORDS)]
    rows = levels.select(
        "node", "level", (F.col("level") == F.col("own_level")).alias("own"), "size", *words, F.explode(cells).alias("cell")
    )
    return rows.groupBy("node", "level", F.col("cell.part").alias("part")).agg(
        F.bit_xor("cell.hash").alias("signature"),
        F.any_value("own").alias("own"),
        F.any_value("size").alias("size"),
        *[F.any_value(w).alias(w) for w in words],
    )


def _could_be_near(threshold: float) -> Column:
    """Size ratio and sketch distance that every near pair satisfies."""
    a, b = F.col("a.size"), F.col("b.size")
    shared = F.ceil((a + b) * (threshold / (1 + threshold)) - TINY)
    distance = sum(
        (F.bit_count(F.col(f"a.w{k}").bitwiseXOR(F.col(f"b.w{k}"))) for k in range(SKETCH_WORDS)),
        F.lit(0),
    )
    ratio = (a >= b * threshold - TINY) & (b >= a * threshold - TINY)
    return ratio & (distance <= a + b - shared * 2)


def _cut_counted(df: DataFrame, folder: str, name: str, what: Column) -> tuple[DataFrame, int]:
    """As :func:`cut`, with an aggregate of the rows observed while they are written."""
    seen = Observation()
    table = cut(df.observe(seen, what.alias("n")), folder, name)
    return table, seen.get["n"]


def _split_hot(left: DataFrame, right: DataFrame, folder: str, name: str, limit: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Give both sides a (cell_a, cell_b) grid coordinate, so that no join group holds more than about
    ``limit`` rows of either side. Rows of a hot signature are spread over one axis of its grid
    and copied along the other; all other rows stay single. Without a hot signature nothing changes."""

    def sizes(side: DataFrame, column: str) -> DataFrame:
        return side.groupBy(*SIGNATURE).agg(F.count("*").alias(column))

    if left is right:
        both = sizes(left, "n_a").withColumn("n_b", F.col("n_a"))
    else:
        both = sizes(left, "n_a").join(sizes(right, "n_b"), SIGNATURE)
    splits = lambda c: F.ceil(F.col(c) / limit).cast("int")
    hot = both.filter((F.col("n_a") > limit) | (F.col("n_b") > limit)).select(
        *SIGNATURE, splits("n_a").alias("split_a"), splits("n_b").alias("split_b")
    )
    grid, found = _cut_counted(hot, folder, f"{name}-grid", F.count(F.lit(1)))
    if not found:
        return left, right, list(SIGNATURE)
    one = F.lit(1)

    def place(side: DataFrame, spread: str, copied: str) -> DataFrame:
        sized = side.join(grid, SIGNATURE, "left").withColumns(
            {"split_a": F.coalesce("split_a", one), "split_b": F.coalesce("split_b", one)}
        )
        return sized.withColumns(
            {
                f"cell_{spread}": F.pmod(F.xxhash64("node"), F.col(f"split_{spread}")).cast("int"),
                f"cell_{copied}": F.explode(F.sequence(F.lit(0), F.col(f"split_{copied}") - 1)),
            }
        ).drop("split_a", "split_b")

    return place(left, "a", "b"), place(right, "b", "a"), [*SIGNATURE, "cell_a", "cell_b"]


def candidates(
    left: DataFrame, right: DataFrame, threshold: float, *, folder: str, name: str, limit: int = 2000, salt: bool = True
) -> DataFrame:
    """Distinct pairs ``(a, b)``, a < b, that share a signature and could be near.

    ``salt=False`` is for a caller who knows that either side has at most ``limit`` nodes."""
    keys, itself = list(SIGNATURE), left is right
    if salt:
        left, right, keys = _split_hot(left, right, folder, name, limit)
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    one, other = F.col("a.node"), F.col("b.node")
    if itself:
        # The smaller set, or either one within a band, always meets the other with its own rows.
        left = left.filter("own")
        met = F.when(F.col("b.own"), one < other).otherwise(one != other)
        pair = [F.least(one, other).alias("a"), F.greatest(one, other).alias("b")]
    else:
        met = (one < other) & (F.col("a.own") | F.col("b.own"))
        pair = [one.alias("a"), other.alias("b")]
    pairs = left.alias("a").join(right.alias("b"), [*same, met, _could_be_near(threshold)])
    return pairs.select(*pair).distinct()


def _size_cuts(both: DataFrame, place: Column) -> list[float]:
    """Places in the order of sizes between the blocks, which hold about the same number of nodes. Approximate quantiles
    do: every pair whose sizes allow it meets in one cell, wherever the blocks end."""
    total = both.count()
    blocks = max(min(BLOCKS, math.ceil(total / BLOCK)), math.ceil(total / MOST_IN_BLOCK))
    if blocks < 2:
        return []
    found = both.agg(F.percentile_approx(place, [i / blocks for i in range(1, blocks)], 10000).alias("cuts")).first()["cuts"]
    return sorted(set(found or []))


def grid_candidates(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """As :func:`candidates`, from the :func:`sketches` of both sides instead of their signatures.

    Nodes are dealt into blocks by size, equal sizes by their hash; a cell holds two blocks with sizes that can be near,
    and a node is copied to the cells of its block."""
    itself = left is right
    place = F.col("size") + F.pmod(F.xxhash64("node"), F.lit(1 << 20)) / (1 << 20)
    cuts = _size_cuts(left if itself else left.unionByName(right), place)
    low, high = [0, *map(math.floor, cuts)], [*map(math.ceil, cuts), math.inf]
    blocks = range(len(low))
    meet = {
        (p, q) for p in blocks for q in blocks
        if high[p] >= low[q] * threshold - TINY and high[q] >= low[p] * threshold - TINY and (p <= q or not itself)
    }

    def dealt(side: DataFrame, role: int) -> DataFrame:
        """The rows once per cell of their block, as its first (role 0) or second; a cell of one block needs no second."""
        others = [[c[1 - role] for c in sorted(meet) if c[role] == p and not (itself and role and c[0] == c[1])] for p in blocks]
        own = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= place)) if cuts else F.lit(0)
        lists = F.array(*[F.array(*map(F.lit, o)).cast("array<int>") for o in others])
        spread = side.filter("node is not null").withColumn("mine", own).withColumn("other", F.explode(F.get(lists, F.col("mine"))))
        cell = ("mine", "other") if role == 0 else ("other", "mine")
        return spread.select("node", "size", *words, F.lit(role).alias("role"), *(F.col(c).alias(n) for c, n in zip(cell, "pq")))

    words = [f"w{k}" for k in range(SKETCH_WORDS)]
    kind = left.schema["node"].dataType
    out = T.StructType([T.StructField(c, kind) for c in "xy"])

    def compare(cell: pa.Table) -> pa.Table:
        role = cell.column("role").to_numpy()
        alone = itself and cell.column("p")[0] == cell.column("q")[0]
        sides = []
        for r in (0, 0 if alone else 1):
            at = np.flatnonzero(role == r)
            size = cell.column("size").to_numpy()[at]
            order = np.argsort(size, kind="stable")
            at = at[order]
            sides.append((at, size[order], [cell.column(w).to_numpy()[at].view(np.uint64) for w in words]))
        i, j = _near_sketches(sides[0][1:], sides[1][1:], threshold, alone)
        node = cell.column("node").combine_chunks()
        return pa.table({c: node.take(pa.array(s[0][k])) for c, s, k in zip("xy", sides, (i, j))})

    rows = dealt(left, 0).unionByName(dealt(right, 1)).repartition(len(meet), "p", "q")
    pairs = rows.groupBy("p", "q").applyInArrow(compare, out)
    pairs = pairs.filter("x <> y" if itself else "x < y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _near_sketches(left: tuple, right: tuple, threshold: float, alone: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of the pairs that satisfy what ``_could_be_near`` says; each side is its sizes in rising order and
    its sketch words. ``alone``: both sides are the same rows, and i < j."""
    (a, v), (b, w) = left, right
    start = np.searchsorted(b, a * threshold - TINY, "left")
    end = np.searchsorted(b, (a + TINY) / threshold, "right")
    if alone:
        start = np.maximum(start, np.arange(len(a)) + 1)
    most = lambda x, y: x + y - 2 * np.ceil((x + y) * (threshold / (1 + threshold)) - TINY)
    # folded into one word, the sketches still differ in no more bits than tokens, and nearly all pairs show it there
    x, y = np.bitwise_xor.reduce(v), np.bitwise_xor.reduce(w)
    found_i, found_j = [], []
    for i in np.flatnonzero(start < end).tolist():
        s, e = start[i], end[i]
        # the largest set may differ most, but for rounding
        j = np.flatnonzero(np.bitwise_count(y[s:e] ^ x[i]) <= np.uint8(min(64, most(a[i], b[e - 1]) + 2))) + s
        if len(j):
            far = sum(np.bitwise_count(right_word[j] ^ left_word[i]).astype(np.int64) for right_word, left_word in zip(w, v))
            j = j[(far <= most(a[i], b[j])) & (b[j] >= a[i] * threshold - TINY) & (a[i] >= b[j] * threshold - TINY)]
            found_i.append(np.full(len(j), i))
            found_j.append(j)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_i]), np.concatenate([none, *found_j])


def with_payload(pairs: DataFrame, nodes: DataFrame, column: str) -> DataFrame:
    """Attach ``column`` of both nodes as ``left`` and ``right``.

    The leader of a dense group is the ``a`` of very many pairs. Its join comes last, when the rows already carry
    the other payload, so that adaptive execution sees the true size of the hot key and splits it."""
    left = nodes.select(F.col("node").alias("a"), F.col(column).alias("left"))
    right = nodes.select(F.col("node").alias("b"), F.col(column).alias("right"))
    return pairs.join(right, "b").join(left, "a")


def jaccard_verify(nodes: DataFrame, threshold: float) -> Verify:
    def verify(pairs: DataFrame) -> DataFrame:
        scored = with_payload(pairs, nodes, "tokens").withColumn("similarity", set_similarity(F.col("left"), F.col("right")))
        return scored.filter(F.col("similarity") >= threshold).select("a", "b", "similarity")

    return verify


def sequence_verify(nodes: DataFrame, threshold: float, column: str = "text") -> Verify:
    """``column`` holds the lower-case text. The ratio is not symmetric: always (earlier, later)."""

    def verify(pairs: DataFrame) -> DataFrame:
        return sequence_ratios(with_payload(pairs, nodes, column), threshold)

    return verify


def sequence_token_threshold(threshold: float) -> float:
    """The character bags of two texts with ratio >= t have at least this Jaccard similarity, since
    the matched characters are part of the common bag: 2M/T >= t."""
    return threshold / (2 - threshold)


def similar_pairs(
    nodes: DataFrame, threshold: float, verify: Verify, token_threshold: float | None = None, grid: bool = False
) -> DataFrame:
    """All near pairs ``(a, b, similarity)`` with a < b. ``grid`` is for tokens of a small universe."""
    spark = nodes.sparkSession
    folder = work_folder(spark)
    token_threshold = token_threshold or threshold
    if grid:
        short = cut(sketches(nodes), folder, "sketches")
        return verify(cut(grid_candidates(short, short, token_threshold), folder, "candidates"))
    signed = cut(signatures(nodes, token_threshold), folder, "signatures")
    return verify(candidates(signed, signed, token_threshold, folder=folder, name="all"))


# --- greedy leaders -----------------------------------------------------------------------------


def _settle(edges: DataFrame, open_count: int, folder: str, name: str) -> DataFrame | None:
    """Members among the nodes of ``edges``: in order, a node is a member as soon as an earlier
    neighbour is a leader, and a leader once all its earlier neighbours are members.

    One table is written per round. It holds the edges still open and the members found in that round."""
    members, rounds = None, 0
    open_edges = edges.select("a", "b")
    while open_count:
        rounds += 1
        leaders = open_edges.select("a").distinct().join(open_edges.select(F.col("b").alias("a")), "a", "left_anti")
        found = open_edges.join(leaders, "a", "left_semi").select("b").distinct()
        rest = open_edges.join(found.select(F.col("b").alias("a")), "a", "left_anti").join(found, "b", "left_anti")
        step = rest.select(F.lit("edge").alias("kind"), "a", "b").unionByName(
            found.select(F.lit("member").alias("kind"), F.lit(None).cast("long").alias("a"), "b")
        )
        state, open_count = _cut_counted(step, folder, f"{name}-round{rounds}", F.count_if(F.col("kind") == "edge"))
        new = state.filter("kind = 'member'").select("b")
        members = new if members is None else members.unionByName(new)
        if rounds % COMPACT_EVERY == 0:
            members = cut(members, folder, f"{name}-members{rounds}")
        open_edges = state.filter("kind = 'edge'").select("a", "b")
    log.info("leader rounds: %d", rounds)
    return members


def greedy_leaders(
    nodes: DataFrame,
    threshold: float,
    verify: Verify,
    token_threshold: float | None = None,
    first_batch: int = 8192,
    growth: int = 16,
    limit: int = 2000,
    grid: bool = False,
) -> DataFrame:
    """``(node, leader)``: in node order, a node not yet absorbed leads and absorbs every later near node.

    Nodes are taken in growing batches by order. A batch first meets the leaders found so far,
    which absorb most of any dense group; only what remains is compared within the batch
    and settled in parallel rounds (Blelloch et al., SPAA 2012). So no stage lists all pairs of a dense
    group, and the result is that of the sequential rule."""
    spark = nodes.sparkSession
    folder = work_folder(spark)
    token_threshold = token_threshold or threshold
    total, distinct = nodes.agg(F.count(F.lit(1)), F.count_distinct("node")).first()
    if distinct != total:
        raise ValueError("the order column must differ from row to row")
    if total == 0:
        return nodes.select("node", F.col("node").alias("leader"))

    def edges_of(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
        if grid:
            met = cut(grid_candidates(left, right, token_threshold), folder, f"{name}-candidates")
        else:
            met = candidates(left, right, token_threshold, folder=folder, name=name, limit=limit, salt=total > limit)
        return verify(met).select("a", "b")

    signed = sketches(nodes) if grid else signatures(nodes, token_threshold)
    ids = nodes.select("node")
    bounds = _batch_bounds(ids, total, first_batch, growth)
    if len(bounds) > 1:
        signed = cut(signed, folder, "signatures")
    absorbed_parts: list[DataFrame] = []
    leader_ids = None
    for i, (low, high) in enumerate(bounds):
        inside = F.lit(True)
        if low is not None:
            inside = inside & (F.col("node") > low)
        if high is not None:
            inside = inside & (F.col("node") <= high)
        batch, batch_signed = ids.filter(inside), signed.filter(inside)
        if leader_ids is not None:
            led = signed.filter(F.col("node") <= low).join(leader_ids, "node", "left_semi")
            near = edges_of(led, batch_signed, f"b{i}-absorb").groupBy("b").agg(F.min("a").alias("a"))
            absorbed = cut(near, folder, f"b{i}-absorbed")
            taken = absorbed.select(F.col("b").alias("node"))
            batch, batch_signed = (d.join(taken, "node", "left_anti") for d in (batch, batch_signed))
            absorbed_parts.append(absorbed)
        within = edges_of(batch_signed, batch_signed, f"b{i}-within")
        edges, found = _cut_counted(within, folder, f"b{i}-edges", F.count(F.lit(1)))
        members = _settle(edges, found, folder, f"b{i}")
        if members is not None:
            joined = edges.join(members.select(F.col("b").alias("a")), "a", "left_anti")
            absorbed_parts.append(joined.groupBy("b").agg(F.min("a").alias("a")))
            batch = batch.join(members.select(F.col("b").alias("node")), "node", "left_anti")
        new_leaders = batch if high is None else cut(batch, folder, f"b{i}-leaders")
        leader_ids = new_leaders if leader_ids is None else leader_ids.unionByName(new_leaders)
    result = leader_ids.select("node", F.col("node").alias("leader"))
    for part in absorbed_parts:
        result = result.unionByName(part.select(F.col("b").alias("node"), F.col("a").alias("leader")))
    return result


def _batch_bounds(ids: DataFrame, total: int, first_batch: int, growth: int) -> list[tuple[int | None, int | None]]:
    """Order bounds of batches of about first_batch, growth * first_batch, ... nodes. Approximate
    quantiles do: the result does not depend on where the batches end."""
    shares, size = [], first_batch
    while size < total:
        shares.append(size / total)
        size *= growth
    if not shares:
        return [(None, None)]
    cuts = ids.agg(F.percentile_approx("node", shares, 10000).alias("cuts")).first()["cuts"]
    edges = [None, *sorted(set(cuts)), None]
    return list(zip(edges[:-1], edges[1:]))
