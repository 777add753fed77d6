"""The index of balls against similarity matrices, and what it leaves out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.functions.hashing import draw
from evalspark.operators import balls, pool, vectors

SMALL = balls.Sizes(ball=60, chunk_bytes=8 * 8 * 50, sample_bytes=8 * 8 * 300)


def unit(x):
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def clustered(n, clusters=25, noise=0.15, seed=1):
    """Tight clusters, copies and zero vectors."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(clusters, 8))[np.arange(n) % clusters] + noise * r.normal(size=(n, 8))
    x[5:40] = x[4]
    x[[50, 60]] = 0
    return x


def frame(spark, x, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], v.tolist()) for i, v in enumerate(x)], f"sample_id {'long' if ids is None else 'string'}, embedding array<double>").repartition(5)


def brute_hits(x, q, n, threshold):
    sim = np.round(unit(q) @ unit(x).T, 12)
    return {i: [(int(j), sim[i, j]) for j in sorted(np.flatnonzero(sim[i] >= threshold), key=lambda j: (-sim[i, j], j))[:n]] for i in range(len(q))}


@pytest.mark.parametrize(("n", "threshold"), [(10, 0.0), (40, 0.5), (3, -1.0)])
def test_search_is_exact(spark, n, threshold):
    x = clustered(1500)
    q = np.concatenate([x[::60], np.zeros((1, 8)), np.random.default_rng(7).normal(size=(5, 8))])
    asks = frame(spark, q).withColumnRenamed("sample_id", "query_id")
    got = {}
    for r in vectors.find_similar(frame(spark, x), asks, n, threshold, SMALL).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["sample_id"], round(r["similarity"], 12)))
    want = {k: v for k, v in brute_hits(x, q, n, threshold).items() if v}
    assert {k: [j for j, _ in v] for k, v in got.items()} == {k: [j for j, _ in v] for k, v in want.items()}


def test_every_row_at_a_threshold(spark):
    x = clustered(600)
    asks = frame(spark, x[:20]).withColumnRenamed("sample_id", "query_id")
    got = {(r["query_id"], r["sample_id"]) for r in vectors.find_similar(frame(spark, x), asks, None, 0.9, SMALL).collect()}
    assert got == {(i, j) for i, v in brute_hits(x, x[:20], 10**6, 0.9).items() for j, _ in v}


def test_queries_visit_few_balls_and_points_travel_once(spark):
    x = clustered(3000)
    index = balls.indexed(frame(spark, x), "sample_id", SMALL)
    asks = index.points.where("id % 50 = 0").select(F.col("id").alias("ask"), "vec")
    sent = balls.routed(index, asks, vectors.least_of(5, 0.0))
    shards = index.points.select("shard").distinct().count()
    assert shards >= 50 and sent.count() < 0.15 * shards * asks.count()
    assert index.points.count() == 3000 and index.points.select("id").distinct().count() == 3000
    hits = vectors.hits(index, asks, 5, 0.0)
    seen = hits._jdf.queryExecution().optimizedPlan().toString().count("001-vectors") + hits._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression")
    assert seen == 1  # one shuffle of points and queries together


def test_earlier_ones_with_pruning(spark):
    """Equal to the matrix, and the pairs compared grow well below the square."""
    compared = {}
    for n in (1000, 4000):
        x = clustered(n, clusters=n // 80)
        df = frame(spark, x)
        near = (np.tril(unit(x) @ unit(x).T >= 0.95, -1)).any(1)
        assert {r["sample_id"] for r in vectors.with_earlier(df, 0.95, SMALL).collect()} == set(np.flatnonzero(near))
        index = balls.indexed(df, "sample_id", SMALL)
        asks = index.points.select(F.col("id").alias("ask"), "vec")
        size = index.points.groupBy("shard").agg(F.count("*").alias("n"))
        compared[n] = balls.routed(index, asks, vectors.least_of(None, 0.95)).join(size, "shard").agg(F.sum("n")).first()[0]
    assert compared[4000] < 8 * compared[1000] and compared[4000] < 0.1 * 4000**2


def test_edges(spark):
    x = clustered(100)
    asks = frame(spark, x[:3]).withColumnRenamed("sample_id", "query_id")
    empty = frame(spark, x).limit(0)
    assert vectors.find_similar(empty, asks, 5).count() == 0
    assert vectors.find_similar(frame(spark, x), asks.limit(0), 5).count() == 0
    assert vectors.with_earlier(empty, 0.5).count() == 0
    nulls = frame(spark, x).withColumn("embedding", F.when(F.col("sample_id") >= 10, F.col("embedding")))
    assert vectors.find_similar(nulls, asks, 1000, -1.0, SMALL).where("query_id = 1").count() == 90
    zeros = frame(spark, np.zeros((30, 8)))
    assert [r["sample_id"] for r in vectors.find_similar(zeros, asks, 2, 0.0, SMALL).where("query_id = 0").orderBy("rank").collect()] == [0, 1]
    assert vectors.with_earlier(zeros, 0.0, SMALL).count() == 29 and vectors.with_earlier(zeros, 0.1, SMALL).count() == 0
    named = vectors.find_similar(frame(spark, x, [f"n{i:03}" for i in range(100)]), asks, 2, 0.0, SMALL)
    assert named.where("query_id = 7 or rank > 2").count() == 0 and named.count() == 6


def test_contexts(spark):
    fields = {"name_of_task": "a", "done": "x"}
    tasks = spark.createDataFrame([(1, fields, "code 1"), (2, {}, None), (3, {"k": "v"}, "code 3")], "other long, fields map<string,string>, content string")
    candidates = spark.createDataFrame([(10,), (20,)], "candidate long")
    near = spark.createDataFrame([(10, 2, 0.9, 1), (10, 1, 0.8, 2)], "candidate long, other long, similarity double, rank int")
    of = lambda kind: {r["candidate"]: r["context"] for r in pool.context_rows(candidates, near, tasks, kind).collect()}
    begin, end = "[[START OF ADDITIONAL EXISTING TASK]]\n", "[[END OF ADDITIONAL EXISTING TASK]]\n\n"
    about = [f"{begin}Task description: \n\n", f"{begin}Task description: \nName of task: a\n\n"]
    assert of("metadata") == {10: f"{about[0]}{end}{about[1]}{end}", 20: ""}
    assert of("content")[10] == f"{begin}Task code: \n\n{end}{begin}Task code: \ncode 1\n{end}"
    assert of("all")[10] == f"{about[0]}Task code: \n\n{end}{about[1]}Task code: \ncode 1\n{end}"
    with pytest.raises(ValueError, match="representation"):
        of("other")


def test_random_tasks(spark):
    candidates = spark.range(3000).withColumnRenamed("id", "candidate")
    tasks = spark.createDataFrame([(i * 10,) for i in range(6)], "task_number long")
    got = {}
    for r in pool.random_tasks(candidates, tasks, 3, lambda c, i: draw(c, 40 + i)).orderBy("candidate", "rank").collect():
        got.setdefault(r["candidate"], []).append(r["other"])
        assert r["similarity"] == 1.0
    assert len(got) == 3000 and all(len(set(x)) == 3 for x in got.values())
    shares = [sum(t in x for x in got.values()) / 3000 for t in range(0, 60, 10)]
    assert all(abs(s - 0.5) < 0.05 for s in shares)
    first = pool.random_tasks(candidates, tasks, 2, None)
    assert {(r["other"], r["rank"]) for r in first.collect()} == {(0, 1), (10, 2)}
    assert pool.random_tasks(candidates.limit(1), tasks, 9, lambda c, i: draw(c, i)).count() == 6
    assert pool.random_tasks(candidates, tasks.limit(0), 2, None).count() == 0
