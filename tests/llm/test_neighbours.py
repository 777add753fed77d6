import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.llm.neighbours import Graph, nearest


def brute(rows, asks, k):
    def fine(v):
        return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)

    use = [(i, np.array(v, float)) for i, v in rows if fine(v)]
    out = {}
    for q, v in use:
        if not asks(q):
            continue
        near = sorted(((-(v @ w) / (np.linalg.norm(v) * np.linalg.norm(w)), i) for i, w in use if i != q and len(w) == len(v)), key=lambda x: (round(x[0], 12), x[1]))
        best = {}
        for s, i in near:
            best.setdefault(i, -s)
        out[q] = list(best.items())[:k]
    return out


def found(df, asks, k, p=Graph()):
    out = {}
    for r in nearest(df, asks, k, p).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_larger_tables(spark, sf_dir, sf):
    df = spark.read.parquet(f"{sf_dir}/../{sf}/embeddings.parquet")
    x = df.orderBy("vec_id").toPandas()
    v = np.stack(x["embedding"].to_numpy()).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    asks = np.flatnonzero(x["vec_id"] % 50 == 0)
    sim = v[asks] @ v.T
    sim[np.arange(len(asks)), asks] = -2
    want = {int(x["vec_id"][q]): set(x["vec_id"].to_numpy()[np.argsort(-s, kind="stable")[:5]].tolist()) for q, s in zip(asks, sim, strict=True)}
    got = found(df, F.pmod("vec_id", F.lit(50)) == 0, 5)
    assert set(got) == set(want)
    assert np.mean([len({i for i, _ in got[q]} & want[q]) / 5 for q in want]) >= 0.9


def test_recall_and_scores(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    want = brute([(r["vec_id"], r["embedding"]) for r in df.collect()], lambda i: i % 50 == 0, 5)
    for p in (Graph(), Graph(shard_rows=120, block_rows=3)):
        got = found(df, F.pmod("vec_id", F.lit(50)) == 0, 5, p)
        assert set(got) == set(want) and all(len(x) == 5 for x in got.values())
        assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 5 for q in want]) >= 0.9
        by = {q: dict(x) for q, x in want.items()}
        assert all(abs(by[q][i] - s) < 1e-12 for q, x in got.items() for i, s in x if i in by[q])


def test_copies_of_one_vector(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 else rng.normal(size=3).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = found(df, F.col("vec_id").isin(0, 4, 5), 5)
    assert [i for i, _ in got[4]] == [1, 2, 5, 7, 8] and [i for i, _ in got[5]] == [1, 2, 4, 7, 8]
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert [i for i, _ in got[0]] == [i for i, _ in brute(rows, lambda i: i == 0, 5)[0]]


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0, 1.0]), (7, [1.0, 0.0, 0.0]), (8, [3e38, 0.0]), (9, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS key", "2 AS node", "'x' AS ids")
    got = found(df, F.lit(True), 5)
    assert [i for i, _ in got[0]] == [8, 6] and [i for i, _ in got[6]] == [0, 8] and 7 not in got and 2 not in got
    assert got[0][0][1] == pytest.approx(1.0, abs=1e-15)
    assert nearest(df.limit(0), F.lit(True)).count() == 0
    assert nearest(df, F.lit(False)).count() == 0


def test_repeated_ids(spark):
    """Equal rows count once; an id with many vectors is found once and is never its own neighbour."""
    rng = np.random.default_rng(2)
    same = [1.0, 2.0, 3.0]
    rows = [(50, same)] * 8 + [(51, same), (53, same), (53, same)] + [(i, rng.normal(size=3).tolist()) for i in (2, 12, 17, 20, 31, 100)]
    rows += [(7, [1.0 + j / 1e4, 2.0, 3.0]) for j in range(1, 300)] + [(None, same)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    stored = [(r["vec_id"], r["embedding"]) for r in df.where("vec_id is not null").collect()]
    want = brute(stored, lambda i: i in (50, 53, 100), 5)
    for p in (Graph(), Graph(shard_rows=40, block_rows=2, beam=16)):
        got = found(df, F.col("vec_id").isin(50, 53, 100), 5, p)
        assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    two = nearest(df, F.col("vec_id") == 7, 3).groupBy("query_id", "rank").count().collect()
    assert {r["count"] for r in two} == {299} and len(two) == 3
