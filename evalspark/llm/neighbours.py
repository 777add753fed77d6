"""Approximate nearest neighbours by cosine: a robust-pruned directed graph per shard, searched by beams.

Equal vectors are one graph node that knows its smallest ids, so a vector that a third of all rows share costs one
node. Nodes are dealt to shards of bounded size by hash; a task builds the graph of a shard: greedy searches from the
medoid propose neighbours, relaxed distance pruning keeps diverse ones, and pruned reverse edges keep the graph
reachable. Every shard then comes to one task, and the queries come after it, row by row; a beam search runs there for
a block of them in step. So a shard is read once, whatever the number of queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.common import Scratch


@dataclass(frozen=True)
class Graph:
    degree: int = 32
    build_beam: int = 64
    beam: int = 160
    relax: float = 1.15
    #: Expected vectors of a shard; with more than ``shards`` shards they grow, up to ``shard_rows_max``.
    shard_rows: int = 8192
    shards: int = 1024
    shard_rows_max: int = 65_536
    #: Queries that a task searches for at a time.
    block_rows: int = 512
    #: Beam entries that each query expands per step.
    wide: int = 4


def usable(v: Column) -> Column:
    """Neither null nor zero, and every component is a finite number."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & fine & F.exists(v, lambda x: x != 0)


def beam_search(x: np.ndarray, graph: np.ndarray, start: int, q: np.ndarray, beam: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes (-1 for none) and similarities of each query's beam, best first. ``x`` and ``q`` have unit rows."""
    rows, n = len(q), len(x)
    seen = np.zeros((rows, n), bool)
    seen[:, start] = True
    ids, sim, done = np.full((rows, beam), -1, np.int32), np.full((rows, beam), -np.inf, np.float32), np.ones((rows, beam), bool)
    ids[:, 0], sim[:, 0], done[:, 0] = start, q @ x[start], False
    live = np.arange(rows)
    while len(live):
        open_ = np.where(done[live], -np.inf, sim[live])
        take = np.argpartition(-open_, min(wide, beam - 1), 1)[:, :wide]
        good = np.take_along_axis(open_, take, 1) > -np.inf
        r = np.repeat(live, take.shape[1]).reshape(take.shape)
        done[r[good], take[good]] = True
        from_ = np.where(good, ids[r, take], -1)
        near = np.where(from_[:, :, None] >= 0, graph[from_], -1).reshape(len(live), -1)
        near.sort(1)
        fresh = near >= 0
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        rr = np.broadcast_to(live[:, None], near.shape)
        fresh &= ~seen[rr, np.maximum(near, 0)]
        seen[rr[fresh], near[fresh]] = True
        got = np.full(near.shape, -np.inf, np.float32)
        got[fresh] = np.einsum("ij,ij->i", x[near[fresh]], q[rr[fresh]])
        all_sim = np.concatenate([sim[live], got], 1)
        top = np.argpartition(-all_sim, beam - 1, 1)[:, :beam]
        ids[live] = np.take_along_axis(np.concatenate([ids[live], near], 1), top, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], np.zeros(near.shape, bool)], 1), top, 1)
        sim[live] = np.take_along_axis(all_sim, top, 1)
        done[live] |= sim[live] == -np.inf
        live = live[~done[live].all(1)]
    order = np.argsort(-sim, 1, kind="stable")
    sim = np.take_along_axis(sim, order, 1)
    return np.where(sim > -np.inf, np.take_along_axis(ids, order, 1), -1), sim


def robust_prune(x: np.ndarray, points: np.ndarray, cand: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """Up to ``degree`` of each point's candidates: the nearest first, without those that a kept one is nearer to."""
    cand = np.sort(cand, 1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    cand[cand == points[:, None]] = -1
    v = x[np.maximum(cand, 0)]
    far = 2 - 2 * np.einsum("pcd,pd->pc", v, x[points])
    far[cand < 0] = np.inf
    out, rows = np.full((len(points), degree), -1, np.int32), np.arange(len(points))
    left = far.copy()
    for k in range(degree):
        pick = left.argmin(1)
        some = left[rows, pick] < np.inf
        if not some.any():
            break
        out[some, k] = cand[rows, pick][some]
        between = 2 - 2 * np.einsum("pcd,pd->pc", v, v[rows, pick])
        left[(relax * relax * between <= far) & some[:, None]] = np.inf
        left[rows, pick] = np.inf
    return out


def build_graph(x: np.ndarray, p: Graph, seed: int = 5) -> tuple[np.ndarray, int]:
    """Out-edges (-1 for none) of each unit vector, and the medoid."""
    n, rng = len(x), np.random.default_rng(seed)
    degree = max(1, min(p.degree, n - 1))
    medoid = int(np.argmax(x @ x.mean(0)))
    if n <= p.degree + 1:
        return np.stack([np.delete(np.arange(n, dtype=np.int32), i) for i in range(n)]) if n > 1 else np.full((1, 1), -1, np.int32), medoid
    graph = rng.integers(0, n, (n, degree), dtype=np.int32)
    for relax in (1.0, p.relax):
        order = rng.permutation(n)
        for at in range(0, n, 512):
            batch = order[at : at + 512]
            found, _ = beam_search(x, graph, medoid, x[batch], p.build_beam, p.wide)
            graph[batch] = robust_prune(x, batch, np.concatenate([found, graph[batch]], 1), degree, relax)
            # reverse edges: each target gets its new sources, and is pruned again
            to, source = graph[batch].ravel(), np.repeat(batch, degree)
            to, source = to[to >= 0], source[to >= 0]
            by = np.argsort(to, kind="stable")
            to, source = to[by], source[by]
            targets, first, count = np.unique(to, return_index=True, return_counts=True)
            for part in np.array_split(np.argsort(count, kind="stable"), max(1, len(targets) // 1024)):
                width = int(count[part].max())
                place = first[part][:, None] + np.arange(width)
                new = np.where(np.arange(width) < count[part][:, None], source[np.minimum(place, len(source) - 1)], -1)
                graph[targets[part]] = robust_prune(x, targets[part], np.concatenate([graph[targets[part]], new], 1).astype(np.int32), degree, relax)
    return graph, medoid


def unit(v: np.ndarray) -> np.ndarray:
    """Unit rows; scaling by the largest component first keeps very long and very short vectors apart from 0 and infinity."""
    v = v / np.abs(v).max(1, keepdims=True)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise cosine in double precision."""
    a, b = a / np.abs(a).max(1, keepdims=True), b / np.abs(b).max(1, keepdims=True)
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


class Shard:
    """The graph of one shard, its vectors, and the ids that each of its nodes stands for."""

    def __init__(self, where: tuple[int, int], ids, sizes, vectors, graph, start: int):
        self.where, self.start = where, start
        self.vectors = np.frombuffer(vectors).reshape(-1, where[0])
        self.unit, self.graph = unit(self.vectors), np.frombuffer(graph, np.int32).reshape(len(self.vectors), -1)
        self.ids, self.sizes = np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int32).astype(np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes

    def nearest(self, names: np.ndarray, asked: np.ndarray, by: np.ndarray, k: int, p: Graph) -> list[np.ndarray]:
        """query id, digest of its vector, id found, score: the ``k`` nearest other ids of each query.

        Where the nodes found hold fewer ids (an id may have many vectors), the beam grows to the whole shard.
        """
        out, open_, beam = [], np.arange(len(names)), max(p.beam, k + 2)
        while len(open_):
            nodes, _ = beam_search(self.unit, self.graph, self.start, unit(asked[open_]), beam, p.wide)
            row, col = np.nonzero(nodes >= 0)
            node = nodes[row, col]
            score = cosine(asked[open_[row]], self.vectors[node])
            each = self.sizes[node]
            row, score = np.repeat(row, each), np.repeat(score, each)
            ids = self.ids[np.repeat(self.first[node] - (np.cumsum(each) - each), each) + np.arange(each.sum())]
            other = ids != names[open_[row]]
            row, score, ids = row[other], score[other], ids[other]
            order = np.lexsort((ids, -score, row))
            row, score, ids = row[order], score[order], ids[order]
            _, again = np.unique(np.column_stack([row, ids]), axis=0, return_index=True)  # the best of each id
            again.sort()
            row, score, ids = row[again], score[again], ids[again]
            count = np.bincount(row, minlength=len(open_))
            rank = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            done = (count >= k) | (beam >= len(self.vectors))
            keep = (rank < k) & done[row]
            out.append([names[open_[row[keep]]], by[open_[row[keep]]], ids[keep], score[keep]])
            open_, beam = open_[~done], 4 * beam
        return [np.concatenate(c) for c in zip(*out, strict=True)]


def nearest(vectors: DataFrame, queries: Column, k: int = 5, params: Graph = Graph()) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest others found for each row that ``queries`` names.

    ``vectors``: vec_id, embedding. Rows with a null id or a null, zero or non-finite vector take no part; vectors of
    different lengths do not meet. Ties go to the smaller vec_id. Fewer candidates than ``k`` are all returned. Extra
    columns are ignored, and an empty table gives no rows. Repeated rows (id and vector) count once, as queries and as
    candidates. An id with several vectors is a query by each of them, is found by the nearest of them, once, and is
    never its own neighbour.
    """
    p, scratch = params, Scratch(vectors.sparkSession)
    clean = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0)).alias("embedding"), queries.alias("asks"))
    clean = scratch.save(clean.withColumn("key", F.xxhash64("embedding")).distinct(), "vectors")
    # the k + 1 smallest ids of a vector suffice: whoever asks, k of them are others
    place = F.row_number().over(Window.partitionBy("key", "embedding").orderBy("vec_id"))
    ranked = clean.select("vec_id", "key", "embedding").distinct().withColumn("place", place).where(F.col("place") <= k + 1)
    nodes = ranked.groupBy("key", "embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    nodes = scratch.save(nodes.select("key", "ids", "embedding", F.size("embedding").alias("dim")), "nodes")
    n = nodes.count()
    shards = max(1, -(-n // min(p.shard_rows_max, max(p.shard_rows, n // p.shards))))

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(first=rows["ids"].map(lambda x: x[0])).sort_values(["first", "key"])
        v = np.stack(rows["embedding"].to_numpy())
        graph, start = build_graph(unit(v), p)
        sizes = rows["ids"].map(len).to_numpy()
        return pd.DataFrame(
            {"dim": [key[0]], "shard": [key[1]], "ids": [np.concatenate(rows["ids"].to_numpy()).astype(np.int64).tobytes()], "sizes": [sizes.astype(np.int32).tobytes()], "vectors": [v.tobytes()], "graph": [graph.tobytes()], "start": [start]}
        )

    dealt = nodes.select("dim", F.pmod("key", F.lit(shards)).cast("int").alias("shard"), "key", "ids", "embedding")
    built = scratch.save(dealt.groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, ids binary, sizes binary, vectors binary, graph binary, start int"), "graphs")
    asked = clean.where("asks").select("vec_id", "embedding").distinct()
    asked = scratch.save(asked.select(F.size("embedding").alias("dim"), F.col("vec_id").alias("query_id"), F.xxhash64("embedding").alias("asked_by"), F.col("embedding").alias("asked")), "asked")
    # the stated queries, in blocks, against every shard: a shard comes to its task once, its queries follow
    to = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    rows = built.unionByName(to, allowMissingColumns=True).repartition(shards, "dim", "shard")
    rows = rows.sortWithinPartitions("dim", "shard", F.col("graph").isNull(), "query_id", "asked_by")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, waiting = None, []

        def found() -> pa.RecordBatch:
            names, by, asked = (np.stack(c) for c in zip(*waiting, strict=True))
            waiting.clear()
            cols = shard.nearest(names, asked, by, k, p)
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.float64())], names=["query_id", "asked_by", "vec_id", "score"])

        for batch in batches:
            asks = batch.column("graph").is_null().to_pylist()
            for i, (dim, number, is_query) in enumerate(zip(batch.column("dim").to_pylist(), batch.column("shard").to_pylist(), asks, strict=True)):
                if not is_query:
                    if waiting:
                        yield found()
                    shard = Shard((dim, number), *(batch.column(c)[i].as_buffer() for c in ("ids", "sizes", "vectors", "graph")), batch.column("start")[i].as_py())
                elif shard is not None and shard.where == (dim, number):
                    waiting.append((batch.column("query_id")[i].as_py(), batch.column("asked_by")[i].as_py(), batch.column("asked")[i].values.to_numpy()))
                    if len(waiting) == p.block_rows:
                        yield found()
        if waiting:
            yield found()

    hits = rows.mapInArrow(search, "query_id long, asked_by long, vec_id long, score double")
    best = hits.groupBy("query_id", "asked_by", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id", "asked_by").orderBy(F.desc("score"), "vec_id"))
    return best.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
