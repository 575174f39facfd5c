"""Embedding groups against brute force."""

import numpy as np

from itemnorm.llm import groups as G
from itemnorm.llm import itq as Q


def brute(rows):
    ok = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(rows[i][1], np.float32).astype(float) for i in ok}
    unit = {i: u / np.linalg.norm(u) for i, u in unit.items()}
    near = {i: [j for j in ok if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9] for i in ok}
    root = list(range(len(rows)))
    for i in ok:
        todo, seen = [i], {i}
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        root[i] = min(seen, key=lambda k: rows[k][0])
    return [(rows[i][0], len(near.get(i, [])), rows[root[i]][0]) for i in range(len(rows))]


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, n_links string")


def test_groups_and_odd_vectors(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=32).tolist()) for i in range(200)]
    for i, v in rows[:30]:
        rows += [(1000 + 10 * i + k, (np.array(v) + rng.normal(size=32) * 0.15).tolist()) for k in range(1 + i % 4)]
    base = rng.normal(size=32)
    rows += [(5000 + k, (base + rng.normal(size=32) * 0.12).tolist()) for k in range(120)]
    rows += [(6000 + k, (base + rng.normal(size=32) * 0.33).tolist()) for k in range(40)]
    rows += [(7000, None), (7001, []), (7002, [0.0] * 32), (7003, [float("nan")] + [1.0] * 31), (7004, [None] + [1.0] * 31),
             (7005, [float("inf")] * 32), (7006, [1e30] * 32), (7007, [1.0] * 32), (7008, [1.0, 2.0]), (7009, [2.0, 4.0])]
    want = brute(rows)
    out = Q.near_groups(table(spark, rows).repartition(3))
    got = {r.vec_id: r for r in out.collect()}
    links, found = sum(n for _, n, _ in want), sum(r.n_links for r in got.values())
    assert len(got) == len(rows) and found >= 0.97 * links and all(got[i].n_links <= n for i, n, _ in want)
    assert all(got[i].kept == (got[i].component_id == i) for i, _, _ in want)
    assert sum(got[i].component_id == c for i, _, c in want) >= 0.97 * len(rows)
    assert all(got[i].n_links == 0 and got[i].kept for i in (7000, 7001, 7002, 7003, 7004, 7005))
    assert got[7006].component_id == 7006 and got[7007].component_id == 7006 and got[7009].component_id == 7008


def test_recall_on_the_table(spark):
    """Neighbours at a cosine of 0.90 to 0.95, planted beside the vectors of the table, which holds no link itself."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").toPandas()
    rng = np.random.default_rng(5)
    x = np.stack(rows["embedding"].to_numpy()).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    noise = rng.normal(size=x.shape)
    noise -= (noise * x).sum(1)[:, None] * x
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    c = rng.uniform(0.9, 0.95, len(x))[:, None]
    every = np.concatenate([x, c * x + np.sqrt(1 - c * c) * noise])
    n = np.concatenate([(every[i : i + 2000] @ every.T >= 0.9).sum(1) - 1 for i in range(0, len(every), 2000)])
    out = Q.near_groups(table(spark, [(i, v.tolist()) for i, v in enumerate(every)]))
    got = {r.vec_id: r.n_links for r in out.collect()}
    have = np.array([got[i] for i in range(len(every))])
    assert (have <= n).all() and have.sum() >= 0.9 * n.sum() and n.sum() >= len(every)


def test_repeated_ids_and_no_rows(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.01]), (2, [0.0, 1.0])]
    out = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in Q.near_groups(table(spark, rows)).collect())
    assert out == [(0, 2, 1, False), (1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True)]
    assert Q.near_groups(table(spark, rows).limit(0)).count() == 0


def test_no_table_is_sent_to_all_tasks(spark, monkeypatch):
    """Files of codes and edges are small beside the rows they stand for once these are exploded and in memory."""
    plans = []

    def noted(df, folder, name, cut=Q.cut):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return cut(df, folder, name)

    monkeypatch.setattr(Q, "cut", noted)
    monkeypatch.setattr(G, "cut", noted)
    rng = np.random.default_rng(2)
    base = rng.normal(size=16)
    rows = [(i, (base + rng.normal(size=16) * (0.05 if i < 60 else 2)).tolist()) for i in range(150)]
    out = Q.near_groups(table(spark, rows))
    plans.append(("result", out._jdf.queryExecution().executedPlan().toString()))
    assert sum("Join" in plan for _, plan in plans) > 8
    assert [name for name, plan in plans if "Broadcast" in plan] == []


def test_only_possible_pairs_are_sent_with_their_vectors(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 24))
    x[200:] = x[:200] + rng.normal(size=(200, 24)) * rng.uniform(0.3, 0.7, (200, 1))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    cosine = unit @ unit.T
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(unit)], "row long, v array<double>")
    pairs = spark.createDataFrame([(i, j) for i in range(400) for j in range(i + 1, 400)], "a long, b long")
    got = {(r.a, r.b) for r in Q.possible(pairs, Q.rounded(rows), 0.9).collect()}
    near = {(i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(cosine >= 0.9))) if i < j}
    assert near <= got and all(cosine[i, j] >= 0.83 for i, j in got) and 20 < len(near) < 200

    sizes = {}

    def noted(df, folder, name, cut=Q.cut):
        out = cut(df, folder, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(Q, "cut", noted)
    Q.near_groups(table(spark, [(i, v.tolist()) for i, v in enumerate(x)])).collect()
    assert sizes["links"] <= sizes["close"] < sizes["met"] / 4
