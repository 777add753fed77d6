import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.llm.common import Scratch
from evalspark.llm.hard_negatives import FAR, Chunk, HardNegatives, indexed, mined, quantised, routed, searched
from evalspark.llm.queries import ORACLES, op12_hard_negatives
from tests.compare import connection, rows

SCHEMA = "vec_id long, embedding array<float>, label int"
SMALL = HardNegatives(cell=40, chunk_bytes=4 * 8 * 25, fan=4, leaf=6, sample_bytes=4 * 8 * 150)


def brute(data):
    good = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v], y) for i, v, y in data if i is not None and v is not None and y is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    dot = lambda a, b: sum(x * z for x, z in zip(a, b))  # noqa: B905, E731
    for n, (i, v, y) in enumerate(good):
        if i % 50 == 0:
            scored = sorted((-dot(v, w), j, z) for m, (j, w, z) in enumerate(good) if m != n)
            for s, j, _ in [x for x in scored if x[2] == y][:5]:
                fit = [x for x in scored if x[2] != y and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
                out += [(i, j, k + 1, x[1], -s, -x[0]) for k, x in enumerate(fit)]
    return sorted(out)


def got(spark, data, params=SMALL):
    df = spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 AS cell", "'x' AS shard", "2 AS ids", "3 AS vec")
    return sorted(tuple(r) for r in mined(df, F.pmod("vec_id", F.lit(50)) == 0, params).collect())


def clustered(n, dim=8, seed=2, labels=3):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, dim))
    x = centres[r.integers(0, 6, n)] + 0.4 * r.normal(size=(n, dim))
    return [(i, [float(np.float32(a)) for a in v], int(y)) for i, (v, y) in enumerate(zip(x, r.integers(0, labels, n), strict=True))]


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    assert rows(op12_hard_negatives(spark, sf).toPandas()) == rows(connection(sf).sql(ORACLES["op12_hard_negatives"]).df())


def test_against_brute_force(spark):
    data = clustered(700)
    assert got(spark, data) == brute(data) and len(brute(data)) > 100


def test_copies_and_ties(spark):
    """A third of all rows is one vector, of several labels; ids of copies decide."""
    data = clustered(400)
    data += [(1000 + i, data[0][1], i % 2) for i in range(200)] + [(5000 + i, data[7][1], data[7][2]) for i in range(3)]
    assert got(spark, data) == brute(data)
    assert got(spark, data + data[:60]) == brute(data + data[:60])  # repeated rows


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 2.0], 1), (50, [], 1), (100, None, 1), (150, [1.0, None], 1), (200, [nan, 1.0], 1), (250, [inf, 1.0], 1), (300, [1.0], None), (None, [1.0, 1.0], 1),
            (1, [1.0, 1.5], 1), (2, [0.9, 1.4, 0.5], 2), (3, [0.8, 1.0], 2), (4, [-1.0, -1.0], 1), (350, [0.0, 0.0], 2)]
    assert got(spark, data) == brute(data)
    assert got(spark, []) == []
    assert got(spark, [(0, [1.0], 1)]) == []
    huge = [(0, [1e30, 1.0], 1), (1, [1e30, 0.0], 1), (2, [2e4, 0.0], 2)]
    assert [r[:2] + (r[3],) for r in got(spark, huge)] == [(0, 1, 2)] or got(spark, huge) == []


def test_chunk_is_exact():
    r = np.random.default_rng(0)
    x, labels = r.integers(-300, 300, (900, 12)).astype(np.int32), r.integers(0, 4, 900)
    chunk = Chunk(x, labels, [[i] for i in range(900)], HardNegatives(fan=5, leaf=20))
    asks, own = x[:40], labels[:40]
    least, most = np.full((40, 2), -FAR), np.full((40, 2), FAR)
    least[:, 1], most[:, 1] = 0, 200_000
    for same in (True, False):
        i, w, s, row = chunk.search(asks, own, least, most, 3, same)
        for q in range(40):
            for k in (0, 1):
                ok = (labels == own[q]) == same
                all_ = sorted(((x[ok] @ asks[q]).tolist()), reverse=True)
                want = [v for v in all_ if least[q, k] <= v <= most[q, k]][: 4 if same else 3]
                assert sorted(s[(i == q) & (w == k)].tolist(), reverse=True)[: len(want)] == want
                assert (chunk.x[row] @ asks.T)[np.arange(len(row)), i].tolist() == s.tolist()


def test_cells_are_left_out(spark):
    """On clustered vectors a search reaches a part of the cells only, and finds the same."""
    r = np.random.default_rng(4)
    centres = 20 * r.normal(size=(30, 8))
    data = [(i, [float(a) for a in centres[i % 30] + r.normal(size=8)], i % 30 // 2) for i in range(1500)]
    params = HardNegatives(cell=50, chunk_bytes=4 * 8 * 1000, fan=4, leaf=16)
    rows_, dim = quantised(spark.createDataFrame(data, SCHEMA), params)
    scratch = Scratch(spark)
    rows_ = scratch.save(rows_, "rows")
    index = indexed(rows_, dim, params, scratch)
    asks = rows_.where("vec_id % 50 = 0").selectExpr("vec_id AS ask", "vec_id AS anchor_id", "label", "vec", f"array({-FAR}L) AS least", f"array({FAR}L) AS most")
    best = searched(index, asks, 5, True)
    bounds = best.where("rank = 5").selectExpr("ask", "score")
    closer = asks.join(bounds, "ask").selectExpr("ask", "anchor_id", "label", "vec", "array(score) AS least", "most")
    cells, reached = index.chunks.count(), routed(index, closer, home=False).count()
    assert cells >= 20 and reached < 0.4 * 30 * cells
    assert index.points.selectExpr("sum(size(ids))").first()[0] == 1500


@pytest.mark.parametrize("same", [True, False])
def test_large_numbers_stay_exact(same):
    x = np.array([[1 << 23] * 200, [(1 << 23) - 1] + [1 << 23] * 199], np.int32)
    chunk = Chunk(x, np.array([0, 0 if same else 1]), [[1], [2]], HardNegatives())
    i, w, s, row = chunk.search(x[:1], np.array([0]), np.array([[-FAR]]), np.array([[FAR]]), 5, same)
    assert ((1 << 46) * 200 - (1 << 23)) in s.tolist()
