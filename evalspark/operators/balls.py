"""An exact index for cosine similarity: balls of vectors, and searches that leave out balls that cannot matter.

A ball is a centre, the largest angle between it and its vectors, and their number. Angles are a metric, so no vector of
a ball is closer to a query than the angle to the centre less the radius. Centres and a sample of vectors are fitted and
kept on a bounded number of rows; every row of the table is in a ball, and radii cover them all.

Searches bring queries to balls: the points of a ball (in chunks of bounded size) come first in a task's stream, then the
queries that its bound lets through. So a point is shuffled once, and a query as often as there are chunks that may
hold something for it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.sources.tables import Tables


@dataclass(frozen=True)
class Sizes:
    #: Vectors per ball as long as there are fewer balls than the most.
    ball: int = 2048
    balls_max: int = 4096
    #: Bytes of vectors that the sample has, on average.
    sample_bytes: int = 8 << 20
    #: Bytes of vectors that a task holds at a time.
    chunk_bytes: int = 8 << 20


#: Rows that a task compares with all centres or with the sample at a time, and rows that it sends on at a time.
COMPARED, SENT = 256, 2048


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero vectors stay."""
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


@dataclass
class Centres:
    """Unit centres, the radius of each ball (below 0: empty), and unit vectors of a sample. The last ball holds zero vectors."""

    points: np.ndarray
    radius: np.ndarray
    sample: np.ndarray

    @classmethod
    def fitted(cls, sample: np.ndarray, balls: int, rounds: int = 6) -> Centres:
        """Spherical k-means on the sample, from vectors far apart; fewer balls if fewer differ."""
        u = units(sample)
        u = u[np.linalg.norm(u, axis=1) > 0]
        if not len(u):
            return cls(np.zeros((0, sample.shape[1])), np.full(1, -1.0), u)
        some = u[np.random.default_rng(len(u)).permutation(len(u))[: 3 * balls]]
        nearest, picked = some @ some[0], [0]
        while len(picked) < balls and nearest.min() < 1 - 1e-9:
            picked.append(int(nearest.argmin()))
            nearest = np.maximum(nearest, some @ some[picked[-1]])
        points = some[picked]
        for _ in range(rounds):
            nearest = (u @ points.T).argmax(1)
            total = np.zeros_like(points)
            np.add.at(total, nearest, u)
            new = units(total)
            points = np.where((np.linalg.norm(new, axis=1) > 0)[:, None], new, points)
        return cls(points, np.full(len(points) + 1, -1.0), u)

    def balls_of(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ball, angle to its centre) of unit vectors."""
        n, zero = len(self.points), ~u.any(1)
        if not n:
            return np.full(len(u), n), np.zeros(len(u))
        similar = u @ self.points.T
        ball = np.where(zero, n, similar.argmax(1))
        return ball, np.where(zero, 0.0, np.arccos(np.clip(similar.max(1), -1, 1)))

    def bounds(self, u: np.ndarray) -> np.ndarray:
        """The highest cosine that each ball may hold for each query, a little raised; below -1 where it is empty."""
        angle = np.arccos(np.clip(u @ self.points.T, -1, 1)) if len(self.points) else np.zeros((len(u), 0))
        most = np.cos(np.maximum(angle - self.radius[:-1], 0)) + 1e-7
        most = np.column_stack([most, np.zeros(len(u))])
        most[~u.any(1)] = 0.0
        most[:, self.radius < 0] = -2.0
        return most

    def at_least(self, u: np.ndarray, k: int) -> np.ndarray:
        """What the k-th best row of each query reaches at least, by the sample; -2 if the sample is smaller."""
        if len(self.sample) < k:
            return np.full(len(u), -2.0)
        return np.partition(u @ self.sample.T, len(self.sample) - k, axis=1)[:, len(self.sample) - k] - 1e-9


def matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """The vectors of a batch; shorter ones are filled up with 0, longer ones are an error (but for an empty index)."""
    raw = batch.column("vec").to_pylist()
    if dim and all(len(x) == 8 * dim for x in raw):
        return np.frombuffer(b"".join(raw), np.float64).reshape(-1, dim)
    if dim and any(len(x) > 8 * dim for x in raw):
        raise ValueError(f"a vector of more than {dim} components")
    return np.frombuffer(b"".join(x.ljust(8 * dim, b"\0") for x in raw) if dim else b"", np.float64).reshape(len(raw), dim)


def as_bytes(rows: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep``, and the embedding as bytes of doubles; rows without an embedding go."""
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            ends, flat = column.offsets.to_numpy(), column.flatten().to_numpy(zero_copy_only=False)
            ends = ends - ends[0]
            vec = pa.array([flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), vec], names=[*keep, "vec"])

    return rows.where("embedding is not null").select(*keep, F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, f"{kinds}, vec binary")


@dataclass
class Balls:
    """points: shard, id, vec; chunks: ball, chunks, first (the smallest id of the ball); centres with radii."""

    points: DataFrame
    chunks: DataFrame
    centres: Broadcast
    dim: int
    tables: Tables


def indexed(rows: DataFrame, key: str, sizes: Sizes = Sizes()) -> Balls:
    """The index of all rows with an embedding: ``key`` names them."""
    spark, tables = rows.sparkSession, Tables(rows.sparkSession)
    points = tables.save(as_bytes(rows.withColumnRenamed(key, "id"), "id"), "vectors")
    n, width = points.agg(F.count("*"), F.max(F.length("vec"))).first()
    dim = (width or 0) // 8
    share = min(1.0, sizes.sample_bytes / (8 * max(dim, 1)) / max(n, 1))
    some = points.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("id", "vec").orderBy("id").collect()
    sample = np.frombuffer(b"".join(r["vec"].ljust(8 * dim, b"\0") for r in some), np.float64).reshape(len(some), dim)
    centres = Centres.fitted(sample, min(sizes.balls_max, -(-n // sizes.ball)))
    bare = spark.sparkContext.broadcast(centres)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, COMPARED):
                part = batch.slice(at, COMPARED)
                ball, angle = bare.value.balls_of(units(matrix(part, dim)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ball, pa.int64()), pa.array(angle)], names=["id", "vec", "ball", "angle"])

    kind = points.schema["id"].dataType.simpleString()
    dealt = tables.save(points.mapInArrow(deal, f"id {kind}, vec binary, ball long, angle double"), "dealt")
    tables.drop(points)
    size = max(1, sizes.chunk_bytes // (8 * max(dim, 1)))
    chunks = dealt.groupBy("ball").agg(F.ceil(F.count("*") / size).alias("chunks"), F.min("id").alias("first"), F.max("angle").alias("radius"))
    chunks = tables.save(chunks, "chunks")
    for r in chunks.collect():  # a row per ball
        centres.radius[r["ball"]] = r["radius"] + 1e-9
    place = shard(F.col("ball"), F.pmod(F.xxhash64("id"), F.col("chunks")))
    points = tables.save(dealt.join(F.broadcast(chunks), "ball").select(place.alias("shard"), "id", "vec"), "points")
    tables.drop(dealt)
    return Balls(points, chunks.select("ball", "chunks", "first"), spark.sparkContext.broadcast(centres), dim, tables)


def shard(ball: Column, chunk: Column) -> Column:
    return F.shiftleft(ball, 40) + chunk


def routed(index: Balls, asks: DataFrame, least: Callable[[Centres, np.ndarray], np.ndarray], which: str = "all") -> DataFrame:
    """ask, vec, least, ball, shard: a row per query and shard that may hold a cosine of ``least`` or more for it.

    ``which``: all such balls, the query's ``own`` ball alone, or all ``other`` ones.
    """
    centres, dim, kind = index.centres, index.dim, asks.schema["ask"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, COMPARED):
                part = batch.slice(at, COMPARED)
                u = units(matrix(part, dim))
                low = least(centres.value, u)
                reach = centres.value.bounds(u) >= low[:, None]
                if which != "all":
                    own = np.zeros_like(reach)
                    own[np.arange(len(u)), centres.value.balls_of(u)[0]] = True
                    reach &= own if which == "own" else ~own
                rows, balls = np.nonzero(reach)
                for first in range(0, len(rows), SENT):  # a query may reach every ball
                    who, ball = rows[first : first + SENT], balls[first : first + SENT]
                    taken = part.take(pa.array(who))
                    yield pa.RecordBatch.from_arrays([taken.column("ask"), taken.column("vec"), pa.array(low[who]), pa.array(ball.astype(np.int64))], names=["ask", "vec", "least", "ball"])

    sent = asks.select("ask", "vec").mapInArrow(run, f"ask {kind}, vec binary, least double, ball long").join(F.broadcast(index.chunks), "ball")
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    return sent.withColumn("chunk", chunk).withColumn("shard", shard(F.col("ball"), F.col("chunk"))).select("ask", "vec", "least", "ball", "shard", "first")


def visited(index: Balls, sent: DataFrame, answer: Callable[[pa.Array, np.ndarray, pa.RecordBatch, np.ndarray], pa.RecordBatch | None], schema: str) -> DataFrame:
    """What ``answer`` gives for each shard (ids, unit vectors) and a batch of the queries sent to it (rows, unit vectors)."""
    dim, ask = index.dim, sent.schema["ask"].dataType
    id_ = index.points.schema["id"].dataType
    points = index.points.select("shard", F.lit(0).alias("kind"), "id", F.lit(None).cast(ask).alias("ask"), "vec", F.lit(None).cast("double").alias("least"))
    queries = sent.select("shard", F.lit(1).alias("kind"), F.lit(None).cast(id_).alias("id"), "ask", "vec", "least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ready = None, [], None
        for batch in batches:
            place, kind = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero((place[1:] != place[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if place[a] != now:
                    now, held, ready = place[a], [], None
                part = batch.slice(a, b - a)
                if kind[a] == 0:
                    held.append((part.column("id"), matrix(part, dim)))
                    continue
                if ready is None and not held:  # its points were left out
                    continue
                if ready is None:
                    ready, held = (pa.concat_arrays([x for x, _ in held]), units(np.concatenate([x for _, x in held]))), []
                for at in range(0, part.num_rows, 256):
                    some = part.slice(at, 256)
                    out = answer(*ready, some, units(matrix(some, dim)))
                    if out is not None and out.num_rows:
                        yield out

    return points.unionByName(queries).repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(run, schema)
