"""Components against union-find, density clusters against the tree of mutual reachability cut at a distance."""

import numpy as np
from pyspark.sql import functions as F

from evalspark.operators import balls, clusters


def joined(n, links):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    return [top(i) for i in range(n)]


def test_components(spark):
    r = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in r.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 520)] + [(900, 900)] + [(700, i) for i in range(701, 760)]
    df = spark.createDataFrame([x if i % 2 else x[::-1] for i, x in enumerate(links)], "a long, b long")
    want = joined(1000, links)
    assert {x["id"]: x["component"] for x in clusters.components(df).collect()} == {i: want[i] for x in links for i in x}
    assert clusters.components(df.limit(0)).count() == 0


def tree_cut(x, similarity, neighbours, least):
    """Prim's tree of mutual reachability, without the edges beyond the cut."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = np.round(u @ u.T, 12)
    core = np.sort(sim, 1)[:, -neighbours]
    reach = np.minimum(sim, np.minimum(core[:, None], core[None, :]))
    inside, best, links = {0}, [(reach[0, j], 0) for j in range(len(x))], []
    while len(inside) < len(x):
        j = max((k for k in range(len(x)) if k not in inside), key=lambda k: best[k][0])
        if best[j][0] >= similarity:
            links.append((best[j][1], j))
        inside.add(j)
        best = [max(best[k], (reach[j, k], j)) for k in range(len(x))]
    top = joined(len(x), links)
    large = sorted(t for t in set(top) if top.count(t) >= least)
    return [large.index(t) if t in large else -1 for t in top]


def test_clusters_equal_the_cut_tree(spark):
    r = np.random.default_rng(5)
    x = np.concatenate([c + 0.25 * r.normal(size=(60, 6)) for c in 2 * r.normal(size=(6, 6))] + [r.normal(size=(140, 6))])
    x = x[r.permutation(500)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "sample_id long, embedding array<double>").repartition(4)
    sizes = balls.Sizes(ball=50, chunk_bytes=8 * 6 * 30)
    for similarity, neighbours, least in ((0.98, 4, 10), (0.9, 3, 5)):
        got = {r_["sample_id"]: r_["cluster"] for r_ in clusters.density_clusters(df, similarity, neighbours, least, sizes).collect()}
        want = tree_cut(x, similarity, neighbours, least)
        assert [got[i] for i in range(500)] == want and len(set(want)) > 2 and -1 in want
    none = df.withColumn("embedding", F.when(F.col("sample_id") < 0, F.col("embedding")))
    assert {r_["cluster"] for r_ in clusters.density_clusters(none, 0.9).collect()} == {-1}


def test_clusters_without_structure_send_few_vectors(spark, monkeypatch):
    """Vectors that have their neighbours in a block are never sent to balls; those that do not are, and ids may repeat or be null."""
    r = np.random.default_rng(8)
    x = np.column_stack([r.normal(size=(900, 5)), np.zeros(900)])
    x[8], x[9] = 0.0, x[10]
    lone = np.array([0.0] * 5 + [9.0])
    ids = [*range(900)]
    ids[20], ids[30] = 21, None
    rows = [(i, v.tolist()) for i, v in zip(ids, x, strict=True)] + [(2000 + i, (lone + 1e-3 * i).tolist()) for i in range(4)]
    df = spark.createDataFrame(rows, "sample_id long, embedding array<double>").repartition(3)
    sent, visited = [], balls.visited
    monkeypatch.setattr(balls, "visited", lambda index, asks, *rest: (sent.append(asks.select("ask").distinct().count()), visited(index, asks, *rest))[1])
    got = sorted(map(tuple, clusters.density_clusters(df, 0.8, 3, 3, balls.Sizes(ball=64, chunk_bytes=8 * 6 * 300)).collect()), key=str)
    assert len(sent) == 2 and 0 < max(sent) < 450
    u = np.array([v for _, v in rows])
    u = balls.units(u)
    hit = np.round(u @ u.T, 12) >= 0.8
    ids = [i for i, _ in rows]
    met = {}
    for a, i in enumerate(ids):
        if i is not None:
            met[i] = met.get(i, 0) + int(hit[a].sum())
    links = [(ids[a], ids[b]) for a, b in np.argwhere(hit) if ids[a] is not None and ids[b] is not None and met[ids[a]] >= 3 and met[ids[b]] >= 3]
    top = joined(2004, links)
    members = {}
    for i, n in met.items():
        if n >= 3:
            members.setdefault(top[i], []).append(i)
    number = {t: k for k, t in enumerate(sorted(t for t, m in members.items() if len(m) >= 3))}
    assert got == sorted(((i, -1 if i is None else number.get(top[i], -1)) for i in ids), key=str) and len(number) >= 2
