"""Density clusters of vectors, and connected components.

Two vectors are joined at a similarity if they are that similar and both have enough neighbours at it: what is left of the
minimum spanning tree of mutual reachability when it is cut there. Only vectors with enough neighbours can be joined. They
meet in blocks first, and over the index of balls what blocks leave open; a task gives back a forest, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.operators import balls
from evalspark.operators.order import placed
from evalspark.operators.vectors import least_of
from evalspark.sources.tables import Tables


def components(links: DataFrame) -> DataFrame:
    """id, component (the smallest id it is linked with, over any number of links) of every id in ``links`` (a, b).

    Rounds of two kinds of stars: larger neighbours move to the smallest one known, then smaller ones. Both are groupings
    with a minimum and a join, and the number of rounds grows with the logarithm of the ids. A round writes its links
    and deletes those of the round before.
    """
    tables = Tables(links.sparkSession)
    now = tables.save(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    ids = tables.save(links.select(F.col("a").alias("id")).union(links.select("b")).distinct(), "ids")
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = tables.save(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        after = tables.save(small, "links")
        tables.drop(large)
        if after.exceptAll(now).isEmpty() and now.exceptAll(after).isEmpty():
            tables.drop(after)
            break
        tables.drop(now)
        now = after
    return ids.join(now.select(F.col("a").alias("id"), F.col("b").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def lowest(similarity: float) -> float:
    """The smallest number that is ``similarity`` or more when it is rounded to 12 places."""
    low, high = similarity - 1e-11, similarity + 1e-11
    while low < (mid := (low + high) / 2) < high:
        low, high = (low, mid) if np.round(mid, 12) >= similarity else (mid, high)
    return high


def pieces(batches: Iterator[pa.RecordBatch], dim: int, size: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, unit vectors) of each block in a stream by blocks; a block of over twice ``size`` rows comes in parts."""
    now, held, n = None, [], 0
    whole = lambda: (pa.concat_arrays([x for x, _ in held]), np.concatenate([x for _, x in held]))
    for batch in batches:
        block = batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if held and (block[a] != now or n + b - a > 2 * size):
                yield whole()
                held, n = [], 0
            part = batch.slice(a, b - a)
            now, n = block[a], n + b - a
            held.append((part.column("id"), balls.units(balls.matrix(part, dim))))
    if held:
        yield whole()


def forest(ids: pa.Array, v: np.ndarray, first: int, end: int, low: float) -> pa.RecordBatch:
    """Links (a, b) that join what the vectors from ``first`` to ``end`` reach among all: fewer than there are vectors."""
    _, at, of = np.unique(ids.dictionary_encode().indices.to_numpy(), return_index=True, return_inverse=True)
    label = at[of]
    for k in range(first, end, balls.COMPARED):
        hit = v[k : min(k + balls.COMPARED, end)] @ v.T >= low
        for i in np.flatnonzero(hit.any(1)):
            met = np.unique(label[hit[i]])
            if met[0] != met[-1]:
                label[np.isin(label, met)] = met[0]
    a = np.flatnonzero(label != at[of])
    return pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(label[a]))], names=["a", "b"])


def density_clusters(vectors: DataFrame, similarity: float, neighbours: int = 4, least: int = 10, sizes: balls.Sizes = balls.Sizes()) -> DataFrame:
    """sample_id, cluster of every vector: numbers from 0 in the order of the smallest ids, -1 for noise.

    ``similarity``: where the tree is cut; ``neighbours``: vectors at that similarity, itself included, that a vector
    needs to be joined with others; ``least``: members that a cluster has. Rows without an embedding are noise.

    Vectors are dealt to blocks by the hash of their id and compared inside first. Most have enough neighbours there;
    only the others are counted over the whole index. Blocks, with some vectors that all of them see, then join most of
    what belongs together; a vector outside of the largest component is compared over the index again. Two vectors
    that are not compared are both in that component, so the result is that of all pairs.
    """
    tables = Tables(vectors.sparkSession)
    kind = vectors.schema["sample_id"].dataType.simpleString()
    rows = vectors.select(F.col("sample_id").alias("id"), "embedding")
    points = tables.save(balls.as_bytes(rows, "id"), "vectors")
    n, width = points.agg(F.count("*"), F.max(F.length("vec"))).first()
    dim, low = (width or 0) // 8, lowest(similarity)
    size = max(1, sizes.chunk_bytes // (8 * max(dim, 1)))
    blocks = max(1, -(-n // size))
    of_block = lambda some: some.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).repartition(blocks, "block").sortWithinPartitions("block")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, u in pieces(batches, dim, size):
            met = [np.count_nonzero(u[k : k + balls.COMPARED] @ u.T >= low, axis=1) for k in range(0, len(u), balls.COMPARED)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(met), pa.int64())], names=["id", "n"])

    def counted(ids: pa.Array, v: np.ndarray, part: pa.RecordBatch, u: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column("ask"), pa.array(np.count_nonzero(u @ v.T >= low, axis=1), pa.int64())], names=["id", "n"])

    def linked(ids: pa.Array, v: np.ndarray, part: pa.RecordBatch, u: np.ndarray) -> pa.RecordBatch:
        return forest(pa.concat_arrays([ids, part.column("ask")]), np.concatenate([v, u]), len(ids), len(ids) + len(u), low)

    def visited(index: balls.Balls, asked: DataFrame, answer: Callable, schema: str) -> DataFrame:
        asks = points.join(asked, "id", "left_semi").select(F.col("id").alias("ask"), "vec")
        return balls.visited(index, balls.routed(index, asks, least_of(None, similarity)), answer, schema)

    near = of_block(points).mapInArrow(count, f"id {kind}, n long").where("id is not null").groupBy("id").agg(F.sum("n").alias("n"))
    near = tables.save(near, "near")
    dense, few, index = near.where(F.col("n") >= neighbours).select("id"), near.where(F.col("n") < neighbours).select("id"), None
    if blocks > 1 and not few.isEmpty():
        index = balls.indexed(rows, "id", sizes)
        late = visited(index, few, counted, f"id {kind}, n long").groupBy("id").agg(F.sum("n").alias("n"))
        dense = dense.unionByName(late.where(F.col("n") >= neighbours).select("id"))
    dense = tables.save(dense, "dense")
    joined = points.join(dense, "id", "left_semi")

    share = min(1.0, size / 4 / max(n, 1)) if blocks > 1 else 0.0
    some = joined.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy("id").toArrow().combine_chunks()
    seen = some.to_batches()[0] if some.num_rows else None
    shown = vectors.sparkSession.sparkContext.broadcast((seen.column("id"), balls.units(balls.matrix(seen, dim))) if seen else None)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, u in pieces(batches, dim, size):
            end = len(u)
            if shown.value:
                ids, u = pa.concat_arrays([ids, shown.value[0]]), np.concatenate([u, shown.value[1]])
            yield forest(ids, u, 0, end, low)

    links = of_block(joined).mapInArrow(meet, f"a {kind}, b {kind}")
    links = tables.save(links.unionByName(dense.select(F.col("id").alias("a"), F.col("id").alias("b"))), "forest")
    found = tables.save(components(links), "components")
    tables.drop(links, near)
    largest = found.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").first() if blocks > 1 else None
    outside = found.where(F.col("component") != (largest["component"] if largest else F.col("component")))
    if largest and not outside.isEmpty():
        if index is None:
            index = balls.indexed(rows.join(dense, "id", "left_semi"), "id", sizes)
        index = replace(index, points=index.points.join(dense, "id", "left_semi"))
        links = visited(index, outside.select("id"), linked, f"a {kind}, b {kind}").distinct()
        links = tables.save(links.unionByName(found.select(F.col("id").alias("a"), F.col("component").alias("b"))), "forest")
        tables.drop(found)
        found = tables.save(components(links), "components")
        tables.drop(links)
    tables.drop(points, dense)
    large = found.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("component")
    named = placed(large, ["component"], "cluster", start=0)
    labels = found.join(named, "component").select(F.col("id").alias("sample_id"), "cluster")
    return vectors.select("sample_id").join(labels, "sample_id", "left").select("sample_id", F.coalesce("cluster", F.lit(-1)).cast("int").alias("cluster"))
