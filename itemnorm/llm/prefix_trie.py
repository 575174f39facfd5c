"""The trie of conversations by their turns, built as a burst trie.

Conversations that agree in all turns are one suffix with a weight. Suffixes stand in containers below trie heads, at
first all in the root's. A container of more than ``LIMIT`` different suffixes bursts: every suffix moves by its next turn's id
into the container of a child, whose node becomes a trie head; bursting goes on in rounds until all containers are small.
These are dealt to shards, sorted, and swept into nodes by a stack. What a container holds in all, its leaves and
tokens to save, then goes up the heads, the last round first.

A turn's id is the MD5 of its role and text. Turns travel as blocks of ``BLOCK`` turns at most, so a conversation is never one row,
however long. The turns behind a block that only one suffix has are a chain and become nodes as they are; if
several suffixes share a whole block, its end is a head of the next level, and levels are settled from the last to the
first. Rounds thus follow the depth to which more than ``LIMIT`` different conversations agree, and levels the depth
to which any two of them do, over ``BLOCK``.

Turns of a conversation are numbered by a range sort, so that a conversation with a third of all rows is sorted by
many tasks. Every round is a written table.
"""

from __future__ import annotations

import hashlib
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemnorm.operators.ordering import with_position

from .common import cut, work_folder

LIMIT = 4096
BLOCK = 64
#: Bytes of joined ids of one row on their way to a digest.
PIECE = 1 << 16

NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
#: What is below a node, in the containers of its head.
BELOW = ["children", "leaves", "saved"]
#: An entry of a container on its way to the sweep.
ENTRY = ["head", "depth", "ids", "chars", "rep", "w", "ends", *BELOW]
AT = ["head", "depth"]


def turn_id(role: Column, text: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))


def place_turns(talk: DataFrame, folder: str, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, id, chars) of every row: its place from 1 in its conversation, in the order of turn (null first),
    role and text; null roles and texts are empty. Rows without a conversation are left out."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = talk.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), empty(role).alias("role"), empty(text).alias("text"),
        F.monotonically_increasing_id().alias("row"),  # parts rows that are alike
    )
    order = ["conv", F.asc_nulls_first("turn"), "role", "text", "row"]
    slim = rows.select("*", turn_id(F.col("role"), F.col("text")).alias("id"), F.length("text").cast("long").alias("chars"))
    at = cut(with_position(slim, order, "at").select("conv", "at", "id", "chars"), folder, "placed")
    first = at.groupBy("conv").agg(F.min("at").alias("first"))
    return at.join(first, "conv").select("conv", (F.col("at") - F.col("first") + 1).alias("pos"), "id", "chars")


# ---------------------------------------------------------------- blocks of turns


def _classes(turns: DataFrame, convs: DataFrame, folder: str) -> DataFrame:
    """(conv, class, turns): the smallest conversation with the same sequence of turns, and their number."""
    mark = [F.bit_xor(F.xxhash64(F.lit(seed), "pos", "id")).alias(f"h{seed}") for seed in (1, 2)]
    marks = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("turns"), *mark)
    marks = cut(convs.join(marks, "conv", "left").na.fill(0), folder, "marks")
    least = cut(marks.groupBy("turns", "h1", "h2").agg(F.min("conv").alias("class")), folder, "least")
    return cut(marks.join(least, ["turns", "h1", "h2"]).select("conv", "class", "turns"), folder, "classes")


def _blocks(turns: DataFrame, classes: DataFrame, folder: str, block: int) -> DataFrame:
    """(class, k, w, ids, chars, last): the turns k*block+1 ... of each class, w conversations of it, last block or not."""
    w = cut(classes.groupBy("class", "turns").agg(F.count(F.lit(1)).alias("w")).where("turns > 0"), folder, "weights")
    own = turns.withColumnRenamed("conv", "class").join(w, "class")
    k = F.floor((F.col("pos") - 1) / block).cast("long").alias("k")
    packed = own.groupBy("class", k, "w", "turns").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "chars"))).alias("t"))
    last = (F.col("k") + 1) * block >= F.col("turns")
    return cut(packed.select("class", "k", "w", "t.id", "t.chars", last.alias("last")).withColumnRenamed("id", "ids"), folder, "blocks")


def _levels(blocks: DataFrame, root: int, folder: str, block: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Level by level, the different blocks below each head: (head, ids, chars, rep, w, ends, more), ``more`` being the
    number of classes that go on behind the block; and the blocks of classes that go on alone, with their head."""
    heads = blocks.where("k = 0").select("class", F.lit(root).cast("long").alias("head"))
    levels, chains, k = [], [], 0
    while True:
        here = blocks.where(F.col("k") == k).join(heads, "class")
        entries = here.groupBy("head", "ids").agg(
            F.min("class").alias("rep"), F.sum("w").alias("w"), F.any_value("chars").alias("chars"),
            F.max(F.when(F.col("last"), F.col("class"))).alias("ends"), F.count_if(~F.col("last")).alias("more"),
        )
        levels.append(cut(entries, folder, f"level{k}"))
        on = levels[-1].where("more > 0").select("head", "ids", F.col("rep").alias("to"), "more")
        if on.isEmpty():
            return levels, chains
        on = here.where(~F.col("last")).join(on, ["head", "ids"]).select("class", F.col("to").alias("head"), "more")
        on = cut(on, folder, f"on{k}")
        rest = blocks.where(F.col("k") > k).join(on.where("more = 1").drop("more"), "class")
        chains.append(cut(rest, folder, f"chain{k}"))
        heads = on.where("more > 1").drop("more")
        k += 1
        if heads.isEmpty():
            return levels, chains


def _chain(chain: DataFrame, k: int, block: int) -> tuple[DataFrame, DataFrame]:
    """The nodes of classes that are alone behind level k, and what is below their heads. Tokens are saved where
    the class has copies; only then the blocks of a class, a small row each, are summed in a window."""
    total = F.aggregate("chars", F.lit(0).cast("long"), lambda s, x: s + x)
    behind = Window.partitionBy("class").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    sums = chain.where("w > 1").select("class", "k", (total * (F.col("w") - 1)).alias("own"))
    sums = sums.select("class", "k", "own", F.coalesce(F.sum("own").over(behind), F.lit(0)).alias("after"))
    parts = chain.join(sums, ["class", "k"], "left").na.fill(0, ["own", "after"])
    each = parts.select("*", F.posexplode("chars").alias("i", "c"))
    rest = F.aggregate(F.slice("chars", F.col("i") + 1, F.size("chars")), F.lit(0).cast("long"), lambda s, x: s + x)
    bottom = F.col("last") & (F.col("i") == F.size("chars") - 1)
    first = (F.col("k") == k + 1) & (F.col("i") == 0)
    nodes = each.select(
        F.col("class").alias("conv_id"), (F.col("k") * block + F.col("i") + 1).alias("depth"),
        F.when(first, F.col("head")).otherwise(F.col("class")).alias("parent_conv_id"), F.col("w").alias("n_convs"),
        F.when(bottom, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        (rest * (F.col("w") - 1) + F.col("after")).alias("saved_tokens"), F.when(bottom, F.col("class")).alias("ends"),
    )
    one = F.lit(1).cast("long")
    below = parts.where(F.col("k") == k + 1).select("head", one.alias("children"), one.alias("leaves"), (F.col("own") + F.col("after")).alias("saved"))
    return nodes, below


# ---------------------------------------------------------------- containers


def _sweep(batches):
    """Nodes of containers whose entries come sorted by head, depth and ids. A node closes when an entry leaves it; then
    its weight, smallest member and sums go to the node above, and its children learn their parent. A container's
    last row stands for its head."""
    names = ["total", *NODE]
    kinds = [pa.bool_(), *[pa.int64()] * len(NODE)]
    done: list[list] = []
    # an open node: [total, smallest member, depth, parent, w, children, leaves, saved, ends], its chars, its closed children
    stack: list[tuple[list, int, list]] = []

    def close(depth: int) -> None:
        while len(stack) > depth:
            node, chars, kids = stack.pop()
            for kid in kids:
                kid[3] = node[1]
            done.extend(kids)
            if node[0]:
                done.append(node)
                continue
            if not node[5]:
                node[6] = 1
            node[7] += (node[4] - 1) * chars
            up, _, siblings = stack[-1]
            siblings.append(node)
            up[1] = min(up[1], node[1])
            up[4] += node[4]
            up[5] += 1
            up[6] += node[6]
            up[7] += node[7]

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)
        done.clear()
        return out

    now, before = None, []
    for batch in batches:
        for head, depth, ids, chars, rep, w, ends, children, leaves, saved in zip(*(c.to_pylist() for c in batch.columns)):
            if (head, depth) != now:
                close(0)
                if len(done) > 20_000:
                    yield flush()
                now, before = (head, depth), []
                stack.append(([True, head, depth, None, 0, 0, 0, 0, None], 0, []))
            shared = 0
            for x, y in zip(before, ids):
                if x != y:
                    break
                shared += 1
            close(1 + shared)
            before = ids
            for i in range(shared, len(ids)):
                stack.append(([False, rep, depth + i + 1, None, 0, 0, 0, 0, None], chars[i], []))
            node = stack[-1][0]
            node[1] = min(node[1], rep)
            node[4] += w
            node[5] += children
            node[6] += leaves
            node[7] += saved
            node[8] = ends
    close(0)
    if done:
        yield flush()


def _settle(entries: DataFrame, folder: str, name: str, limit: int) -> tuple[list[DataFrame], DataFrame]:
    """The nodes below the heads of a level's entries, as tables, and what is below each head: (head, depth, children, leaves,
    saved, ends). ``entries`` has ENTRY, ``skip`` (the ids used up) and ``size`` (the entries of its container)."""
    state, small, rounds = entries, [], []
    while True:
        small.append(state.where(F.col("size") <= limit))
        large = state.where(F.col("size") > limit)
        if large.isEmpty():
            break
        r = len(rounds)
        next_ = F.get("ids", F.col("skip")).alias("next")
        moving = large.where(F.size("ids") > F.col("skip")).withColumn("next", next_)
        born = moving.groupBy(*AT, "next").agg(
            F.min("rep").alias("to"), F.sum("w").alias("n_convs"), F.any_value(F.get("chars", F.col("skip"))).alias("turn"), F.count(F.lit(1)).alias("n")
        )
        born = cut(born, folder, f"{name}-born{r}")
        rounds.append((born, large.where(F.size("ids") == F.col("skip")).select(*AT, *BELOW, "ends")))
        moved = moving.drop("size").join(born.select(*AT, "next", "to", "n"), [*AT, "next"])
        state = moved.select(F.col("to").alias("head"), F.col("depth") + 1, *ENTRY[2:], F.col("skip") + 1, F.col("n").alias("size"))
        state = cut(state.toDF(*ENTRY, "skip", "size"), folder, f"{name}-state{r}")
    every = small[0]
    for more in small[1:]:
        every = every.unionByName(more)
    left = lambda c: F.slice(c, F.col("skip") + 1, F.size("ids")).alias(c)
    every = every.select(*AT, left("ids"), left("chars"), *ENTRY[4:])
    dealt = every.repartition(*AT).sortWithinPartitions(*AT, "ids")
    swept = cut(dealt.mapInArrow(_sweep, "total boolean, " + ", ".join(f"{c} long" for c in NODE)), folder, f"{name}-swept")
    totals = swept.where("total").select("conv_id", "depth", "n_children", "n_leaves", "saved_tokens", "ends").toDF(*AT, *BELOW, "ends")
    nodes = [swept.where(~F.col("total")).select(*NODE)]
    for r, (born, ended) in reversed(list(enumerate(rounds))):
        below = totals.select(F.col("head").alias("to"), (F.col("depth") - 1).alias("depth"), *BELOW, "ends")
        leaves = F.when(F.col("children") == 0, 1).otherwise(F.col("leaves")).cast("long")
        grown = born.join(below, ["to", "depth"]).select(
            "to", F.col("depth") + 1, "head", "n_convs", "children", leaves, F.col("saved") + (F.col("n_convs") - 1) * F.col("turn"), "ends"
        )
        nodes.append(cut(grown.toDF(*NODE), folder, f"{name}-nodes{r}"))
        up = nodes[-1].select(F.col("parent_conv_id"), F.col("depth") - 1, F.lit(1).cast("long"), "n_leaves", "saved_tokens", F.lit(None).cast("long"))
        up = up.toDF(*AT, *BELOW, "ends").unionByName(ended).groupBy(*AT).agg(*(F.sum(c).alias(c) for c in BELOW), F.max("ends").alias("ends"))
        totals = totals.unionByName(cut(up, folder, f"{name}-up{r}"))
    return nodes, totals


def trie(turns: DataFrame, convs: DataFrame, folder: str, limit: int = LIMIT, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The nodes (``NODE``) of the trie and the classes (conv, class, turns) of conversations that agree.

    ``turns`` has (conv, pos, id, chars) with pos from 1 without gaps, ``convs`` every conversation once. ``ends`` is the class that
    ends at a node, if any; the root's is the one of conversations without turns. Without conversations there is no node.
    """
    classes = _classes(turns, convs, folder)
    whole = classes.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("turns") == 0, F.col("class"))).alias("none")).first()
    spark = turns.sparkSession
    schema = ", ".join(f"{c} long" for c in NODE)
    if whole.conv is None:
        return spark.createDataFrame([], schema), classes
    levels, chains = _levels(_blocks(turns, classes, folder, block), whole.conv, folder, block)
    found, below = [], None
    for k in reversed(range(len(levels))):
        if k < len(chains):
            nodes, alone = _chain(chains[k], k, block)
            found.append(nodes)
            below = alone if below is None else below.unionByName(alone)
        entries = levels[k].withColumn("depth", F.lit(k * block).cast("long")).withColumn("skip", F.lit(0))
        if below is None:
            entries = entries.select("*", *(F.lit(0).cast("long").alias(c) for c in BELOW))
        else:
            below = cut(below.withColumnRenamed("head", "rep"), folder, f"below{k}")
            on = entries.where("more > 0").join(below, "rep")
            entries = entries.where("more = 0").select("*", *(F.lit(0).cast("long").alias(c) for c in BELOW)).unionByName(on)
        sizes = cut(levels[k].groupBy("head").agg(F.count(F.lit(1)).alias("size")), folder, f"sizes{k}")
        entries = cut(entries.join(sizes, "head").select(*ENTRY, "skip", "size"), folder, f"entries{k}")
        nodes, totals = _settle(entries, folder, f"l{k}", limit)
        found += nodes
        below = totals.where(F.col("depth") == k * block).select("head", *BELOW)
    out = found[0].select(*NODE)
    for more in found[1:]:
        out = out.unionByName(more.select(*NODE))
    top = below.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in BELOW))
    some = F.lit(None).cast("long") if whole.none is None else F.lit(whole.none).cast("long")
    top = top.select(
        F.lit(whole.conv).cast("long"), F.lit(0).cast("long"), F.lit(None).cast("long"), F.lit(whole.n).cast("long"), "children",
        F.when(F.col("children") == 0, 1).otherwise(F.col("leaves")).cast("long"), "saved", some,
    )
    return cut(out.unionByName(top.toDF(*NODE)), folder, "nodes"), classes


# ---------------------------------------------------------------- digests


def _pieces(batches, piece: int = PIECE):
    """Joined ids of a class, in pieces: (class, first, ids); rows come sorted by class and conversation."""
    names = ["class", "first", "ids"]
    done: list[tuple] = []
    now, own, size = None, [], 0

    def end():
        if own:
            done.append((now, own[0], ",".join(map(str, own))))

    for batch in batches:
        for cls, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if cls != now or size > piece:
                end()
                now, own, size = cls, [], 0
            own.append(conv)
            size += 12
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=names)
            done = []
    end()
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=names)


def _digests(batches):
    """The digest of a class from its pieces in order, one piece at a time."""
    done: list[tuple] = []
    now, sha = None, None
    for batch in batches:
        for cls, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if cls != now:
                if sha is not None:
                    done.append((now, sha.hexdigest()))
                now, sha = cls, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
    if sha is not None:
        done.append((now, sha.hexdigest()))
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["class", "sha"])


def end_digests(classes: DataFrame, folder: str, piece: int = PIECE) -> DataFrame:
    """(class, sha): SHA-256 of the decimal ids of a class's conversations in ascending order, joined by commas. Ids of a large
    class are joined by many tasks, and one task reads the pieces in order."""
    sizes = cut(classes.groupBy("class").agg(F.count(F.lit(1)).alias("n")), folder, "class-sizes")
    single = sizes.where("n = 1").select("class", F.sha2(F.col("class").cast("string").cast("binary"), 256).alias("sha"))
    several = classes.join(sizes.where("n > 1").select("class"), "class").select("class", "conv")
    pieces = several.orderBy("class", "conv").mapInArrow(partial(_pieces, piece=piece), "class long, first long, ids string")
    pieces = cut(pieces, folder, "pieces").repartition("class").sortWithinPartitions("class", "first")
    return single.unionByName(pieces.mapInArrow(_digests, "class long, sha string"))


def with_end_digests(nodes: DataFrame, digests: DataFrame, name: str = "ends_sha256") -> DataFrame:
    """``nodes`` with the digest of the conversations that end at each one in place of ``ends``."""
    none = nodes.where("ends is null").drop("ends").withColumn(name, F.lit(hashlib.sha256(b"").hexdigest()))
    some = nodes.join(digests.withColumnsRenamed({"class": "ends", "sha": name}), "ends").drop("ends")
    return some.unionByName(none)
