"""The trie against plain sets of prefixes."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from itemnorm.llm import prefix_trie, queries
from itemnorm.session import cut, work_folder

SCHEMA = "conv_id long, turn long, role string, text string, conv string, pos int, ends long"


def plain_turns(rows):
    """conv_id -> turns in order."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r[2], r[3]) for r in sorted(t)] for c, t in by.items()}


def plain_rebuilt(turns):
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = turns.get(c - c % 100, [])[:h] + own[h:]
    return out


def plain_nodes(turns):
    at = defaultdict(list)
    for c, path in turns.items():
        for d in range(len(path) + 1):
            at[tuple(path[:d])].append(c)
    kids = defaultdict(set)
    for k in at:
        if k:
            kids[k[:-1]].add(k)
    leaves, saved = {}, {}
    for k in sorted(at, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + ((len(at[k]) - 1) * len(k[-1][1]) if k else 0)
    rows = []
    for k, members in at.items():
        ends = ",".join(str(c) for c in sorted(members) if len(turns[c]) == len(k))
        parent = min(at[k[:-1]]) if k else None
        sha = hashlib.sha256(ends.encode()).hexdigest()
        rows.append((min(members), len(k), parent, len(members), len(kids[k]), leaves[k], saved[k], sha))
    return sorted(rows, key=lambda r: (r[1], r[0]))


def found_nodes(talk, rebuild, limit, block, piece=prefix_trie.PIECE):
    spark = talk.sparkSession
    folder = work_folder(spark)
    placed = cut(prefix_trie.place_turns(talk, folder), folder, "turns")
    convs = placed.select("conv").distinct()
    turns = cut(queries.borrowed(placed), folder, "borrowed") if rebuild else placed
    nodes, classes = prefix_trie.trie(turns, convs, folder, limit, block)
    out = prefix_trie.with_end_digests(nodes, prefix_trie.end_digests(classes, folder, piece))
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in out.select(*cols).collect()), key=lambda r: (r[1], r[0]))


def talk_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3)


def random_rows(seed, n, words, longest):
    rng = np.random.default_rng(seed)
    rows = []
    for c in rng.choice(900, n, replace=False):
        for t in range(rng.integers(1, longest + 1)):
            rows.append((int(c), t, ["user", "assistant"][t % 2], str(rng.choice(words))))
    return rows


@pytest.mark.parametrize("limit,block,seed", [(2, 2, 0), (4, 64, 2)])
def test_against_plain(spark, limit, block, seed):
    rows = random_rows(seed, 40, ["a", "bé", ""], 5)
    assert found_nodes(talk_of(spark, rows), False, limit, block) == plain_nodes(plain_turns(rows))


def test_rebuilt_conversations(spark):
    rows = random_rows(9, 80, ["a", "b", "中 c"], 6)
    rows += [(100, t, "system", "s") for t in range(4)] + [(101, 0, "user", "x"), (102, 0, "user", "x")]
    assert found_nodes(talk_of(spark, rows), True, 9, 64) == plain_nodes(plain_rebuilt(plain_turns(rows)))


def test_odd_rows(spark):
    """Null turns first, null roles and texts empty, ties by role and text, rows that repeat, conversations without an id,
    copies, one inside another, a long one and negative ids."""
    rows = [(1, None, "z", "z"), (1, 0, None, None), (1, 0, "a", None), (1, 0, "a", "b"), (1, 0, "a", "b"), (2, 5, "z", "z"), (None, 1, "a", "b")]
    rows += [(c, t, "u", f"w{t}") for c in (7, 8, 9) for t in range(30)] + [(10, t, "u", f"w{t}") for t in range(12)]
    rows += [(11, t, "u", "w0" if t < 9 else "q") for t in range(25)] + [(-5, 0, "u", "w0"), (-5, 1, "u", "w1"), (12, 0, "u", "x" * 100_000)]
    want = plain_nodes(plain_turns(rows))
    assert found_nodes(talk_of(spark, rows), False, 3, 8) == want


def test_empty(spark):
    assert found_nodes(talk_of(spark, [(1, 0, "a", "b")]).where("false"), True, 2, 2) == []
    assert found_nodes(talk_of(spark, [(None, 0, "a", "b")]), True, 2, 2) == []


def test_conversations_without_turns(spark):
    """Conversations whose turns all give way to those of a missing one are members of the root alone."""
    rows = [(c, 0, "u", "a") for c in range(201, 230)]
    want = plain_nodes(plain_rebuilt(plain_turns(rows)))
    assert found_nodes(talk_of(spark, rows), True, 2, 2) == want and want[0][3] == 29


def test_many_ends_in_pieces(spark):
    rows = [(c, 0, "u", "a" if c % 3 else "b") for c in range(200)]
    assert found_nodes(talk_of(spark, rows), False, 4096, 64, 60) == plain_nodes(plain_turns(rows))
