"""Hard-negative mining over a multiway hyperplane tree (GNAT).

A node of the tree has split points; a vector goes to the child of the nearest one. Every split point keeps the range of
its distances to the vectors below each of its siblings. A search knows in which distances from the query its hits may
lie: inner products between two bounds are an annulus around the query once the norms below a child are known. A child
is left out if for any split point the annulus, seen from there, misses the range. Leaves are compared exactly, in whole
numbers.

The upper levels are fitted on a bounded sample and broadcast; they deal all vectors into cells, whose ranges cover every
vector. A cell comes to a task in chunks of bounded size, which build the lower levels; queries travel to the chunks that
their annuli reach and stream past them. A search has two rounds: the query's own cell gives bounds, then all other cells
that the bounds leave.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.common import Scratch

#: Whole-number components are clamped to this size either way, so that an inner product fits a long.
LARGEST = 1 << 23
FAR = 1 << 62


@dataclass(frozen=True)
class HardNegatives:
    positives: int = 5
    negatives: int = 3
    #: Negatives score between these percentages of the positive's score.
    low: int = 50
    high: int = 95
    #: A component x becomes floor(scale * x).
    scale: int = 256
    #: Vectors per cell as long as there are fewer cells than the most; bytes of the sample that places the cells.
    cell: int = 4096
    cells_max: int = 4096
    sample_bytes: int = 8 << 20
    #: Bytes of vectors that one task holds at a time.
    chunk_bytes: int = 4 << 20
    #: Split points and leaf size inside a chunk.
    fan: int = 16
    leaf: int = 128


@dataclass
class Node:
    """Split points; ``low[i, j]`` and ``high[i, j]``: distances of split point i to the vectors below child j; ``norms``:
    least and largest squared norm below each child. A child is a node, or a number or slice of vectors."""

    points: np.ndarray
    low: np.ndarray
    high: np.ndarray
    norms: np.ndarray
    children: list = field(default_factory=list)

    def reach(self, asks: np.ndarray, least: np.ndarray, most: np.ndarray, j: int, distances: np.ndarray) -> np.ndarray:
        """Which queries' annuli (inner products from ``least`` to ``most``, one pair per window) meet child j."""
        square = np.einsum("ij,ij->i", asks, asks)[:, None]
        outer2 = square + self.norms[1, j] - 2.0 * least
        outer, inner = np.sqrt(np.maximum(outer2, 0)), np.sqrt(np.maximum(square + self.norms[0, j] - 2.0 * most, 0))
        slack = 1e-6 * (1 + distances.max(1, initial=0))[:, None, None] + 1e-9 * outer[:, :, None]
        d, low, high = distances[:, None, :], self.low[:, j], self.high[:, j]
        meets = (d - outer[:, :, None] <= high + slack) & (inner[:, :, None] - d <= high + slack) & (d + outer[:, :, None] >= low - slack)
        return (meets.all(2) & (outer2 >= 0) & (least <= most)).any(1)


def far_apart(x: np.ndarray, m: int) -> np.ndarray:
    """Up to m rows of the first 3 m of x, different from each other: each the farthest from those before it."""
    some = x[: 3 * m]
    best, picked = distances_to(some, some[:1])[:, 0], [0]
    while len(picked) < m and best.max() > 0:
        picked.append(int(best.argmax()))
        best = np.minimum(best, distances_to(some, some[picked[-1:]])[:, 0])
    return some[picked]


def distances_to(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    square = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", points, points)[None, :] - 2.0 * (x @ points.T)
    return np.sqrt(np.maximum(square, 0))


def shuffled(n: int) -> np.ndarray:
    return np.random.default_rng(n).permutation(n)


class Chunk:
    """The lower levels of the tree over one chunk of a cell, and exact search in it."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, ids: list[list[int]], params: HardNegatives):
        self.params, self.order = params, []
        self.x = x.astype(np.float64)
        self.square = np.einsum("ij,ij->i", self.x, self.x)
        self.root = self.grown(shuffled(len(x)))
        order = np.concatenate(self.order)
        self.x, self.labels, self.square, self.ids = self.x[order], labels[order], self.square[order], [ids[i] for i in order]
        self.whole = x[order]

    def grown(self, rows: np.ndarray):
        """A node, or a slice of the leaves' order."""
        points = far_apart(self.x[rows], self.params.fan) if len(rows) > self.params.leaf else None
        if points is None or len(points) == 1:
            begin = sum(map(len, self.order))
            self.order.append(rows)
            return slice(begin, begin + len(rows))
        d = distances_to(self.x[rows], points)
        nearest = d.argmin(1)
        groups = [np.flatnonzero(nearest == j) for j in range(len(points))]
        groups = [g for g in groups if len(g)]
        low, high = (np.stack([f(d[g], 0) for g in groups], 1) for f in (np.min, np.max))
        norms = np.array([[self.square[rows[g]].min() for g in groups], [self.square[rows[g]].max() for g in groups]])
        return Node(points, low, high, norms, [self.grown(rows[g]) for g in groups])

    def search(self, asks: np.ndarray, labels: np.ndarray, least: np.ndarray, most: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, ...]:
        """(query, window, score, row) of a superset of the k best rows of each window: those at its last bound or above.

        ``same``: rows of the query's label, else of other labels. Of the query's own label one row may be itself, so
        one more is kept there.
        """
        n, windows = least.shape
        keep = k + 1 if same else k
        a = asks.astype(np.float64)
        exact = float(np.abs(a).max(initial=0)) * float(np.abs(self.x).max(initial=0)) * a.shape[1] < 2.0**52
        bound, best, found = least.astype(np.float64), np.full((n, windows, keep), -np.inf), []
        least_, most_ = bound.copy(), most.astype(np.float64)

        def leaf(rows: slice, active: np.ndarray) -> None:
            s = a[active] @ self.x[rows].T if exact else (asks[active].astype(np.int64) @ self.whole[rows].T.astype(np.int64))
            ok = ((self.labels[rows][None, :] == labels[active][:, None]) == same)[:, None, :]
            ok = ok & (s[:, None, :] >= np.maximum(bound[active], least_[active])[:, :, None]) & (s[:, None, :] <= most[active][:, :, None])
            i, w, r = np.nonzero(ok)
            if len(i):
                found.append((active[i], w, s[i, r].astype(np.int64), r + rows.start))
                top = np.concatenate([best[active], np.where(ok, s[:, None, :], -np.inf)], 2)
                best[active] = np.partition(top, top.shape[2] - keep, axis=2)[:, :, -keep:]
                bound[active] = np.maximum(bound[active], best[active].min(2))

        def visit(node, active: np.ndarray) -> None:
            if isinstance(node, slice):
                leaf(node, active)
                return
            d = distances_to(a[active], node.points)
            for j in np.argsort(d.mean(0)[: len(node.children)]):
                hit = node.reach(a[active], bound[active], most_[active], j, d)
                if hit.any():
                    visit(node.children[j], active[hit])

        visit(self.root, np.arange(n))
        if not found:
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        i, w, s, r = (np.concatenate(x) for x in zip(*found, strict=True))
        good = s >= bound[i, w]
        return i[good], w[good], s[good], r[good]


@dataclass
class Upper:
    """The upper levels: a node whose children are nodes, whose children are cells by number."""

    root: Node | None
    cells: int
    dim: int

    @classmethod
    def placed(cls, sample: np.ndarray, cells: int) -> Upper:
        """Two levels of about equal fan, with split points out of a sample and no ranges yet."""
        dim, fan = sample.shape[1], int(np.ceil(np.sqrt(cells)))
        if fan <= 1 or not len(sample):
            return cls(None, 1, dim)
        sample = sample[shuffled(len(sample))].astype(np.float64)
        top = far_apart(sample, fan)
        nearest, number = distances_to(sample, top).argmin(1), 0
        empty = lambda m: (np.full((m, m), np.inf), np.full((m, m), -np.inf), np.array([[np.inf] * m, [-np.inf] * m]))
        root = Node(top, *empty(len(top)))
        for j in range(len(top)):
            points = far_apart(sample[nearest == j], fan)
            root.children.append(Node(points, *empty(len(points)), list(range(number, number + len(points)))))
            number += len(points)
        return cls(root, number, dim)

    def cells_of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        if self.root is not None:
            first = distances_to(x, self.root.points).argmin(1)
            for j in np.unique(first):
                at, node = np.flatnonzero(first == j), self.root.children[j]
                out[at] = node.children[0] + distances_to(x[at], node.points).argmin(1)
        return out

    def parents(self) -> Iterator[tuple[int, int, int]]:
        """(child of the root, place in it, cell)."""
        for j, node in enumerate(self.root.children if self.root else []):
            for i, cell in enumerate(node.children):
                yield j, i, cell

    def ranges(self, x: np.ndarray, cells: np.ndarray, found: dict[int, np.ndarray]) -> None:
        """Adds vectors to ``found``: per cell least and largest distances to the root's points, to its own siblings' points, and squared norms."""
        top, of = distances_to(x, self.root.points), {cell: (j, i) for j, i, cell in self.parents()}
        square = np.einsum("ij,ij->i", x, x)
        for cell in np.unique(cells):
            at = cells == cell
            near = distances_to(x[at], self.root.children[of[int(cell)][0]].points)
            values = np.column_stack([top[at], near, square[at]])
            merge_ranges(found, int(cell), np.stack([values.min(0), values.max(0)]))

    def with_ranges(self, found: dict[int, np.ndarray]) -> None:
        m = len(self.root.points)
        for j, i, cell in self.parents():
            if cell in found:
                low, high = found[cell]
                node = self.root.children[j]
                node.low[:, i], node.high[:, i], node.norms[:, i] = low[m:-1], high[m:-1], (low[-1], high[-1])
                self.root.low[:, j], self.root.high[:, j] = np.minimum(self.root.low[:, j], low[:m]), np.maximum(self.root.high[:, j], high[:m])
                self.root.norms[:, j] = min(self.root.norms[0, j], low[-1]), max(self.root.norms[1, j], high[-1])

    def reached(self, asks: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, cell) of all cells that a query's annuli meet."""
        if self.root is None:
            return np.arange(len(asks)), np.zeros(len(asks), np.int64)
        out, d = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], distances_to(asks, self.root.points)
        for j, node in enumerate(self.root.children):
            some = np.flatnonzero(self.root.reach(asks, least, most, j, d)) if np.isfinite(self.root.norms[0, j]) else []
            if len(some):
                near = distances_to(asks[some], node.points)
                for i, cell in enumerate(node.children):
                    if np.isfinite(node.norms[0, i]):
                        hit = some[node.reach(asks[some], least[some], most[some], i, near)]
                        out.append((hit, np.full(len(hit), cell)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def merge_ranges(found: dict[int, np.ndarray], cell: int, new: np.ndarray) -> None:
    old = found.get(cell)
    found[cell] = new if old is None else np.stack([np.minimum(old[0], new[0]), np.maximum(old[1], new[1])])


def vectors_of(batch: pa.RecordBatch, dim: int, column: str = "vec") -> np.ndarray:
    raw = b"".join(batch.column(column).to_pylist())
    return np.frombuffer(raw, np.int32).reshape(batch.num_rows, dim)


def lists_of(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """A matrix of lists of one length."""
    x = batch.column(column)
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def quantised(rows: DataFrame, params: HardNegatives) -> tuple[DataFrame, int]:
    """(vec_id, label, vec: little-endian 32-bit whole numbers, shorter vectors filled up with 0; dimension)."""
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    good = rows.where("vec_id is not null and label is not null and embedding is not null").where(finite)
    good = good.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    dim = max(1, good.agg(F.max(F.size("embedding"))).first()[0] or 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            sizes = np.diff(column.offsets.to_numpy())
            q = np.zeros((batch.num_rows, dim), np.int32)
            whole = np.clip(np.floor(params.scale * column.flatten().to_numpy(zero_copy_only=False)), -LARGEST, LARGEST)
            q[np.arange(dim)[None, :] < sizes[:, None]] = whole
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([x.tobytes() for x in q], pa.binary())], names=["vec_id", "label", "vec"])

    return good.mapInArrow(run, "vec_id long, label long, vec binary"), dim


@dataclass
class Index:
    """points: shard, label, vec, ids (the smallest ids of all rows with this label and vector); chunks: cell, chunks."""

    points: DataFrame
    chunks: DataFrame
    upper: Broadcast
    params: HardNegatives
    scratch: Scratch

    @property
    def dim(self) -> int:
        return self.upper.value.dim


def indexed(rows: DataFrame, dim: int, params: HardNegatives, scratch: Scratch) -> Index:
    """Every row: equal vectors of one label are one point, with as many of its smallest ids as a result can hold.

    The sample of split points is ``sample_bytes`` of vectors by hash; ranges come from all vectors.
    """
    spark, most = rows.sparkSession, 1 + max(params.positives, params.negatives)
    place = F.row_number().over(Window.partitionBy("vec", "label").orderBy("vec_id"))
    first = rows.withColumn("place", place).where(F.col("place") <= most)
    points = scratch.save(first.groupBy("vec", "label").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "points")
    n = points.count()
    share = min(1.0, params.sample_bytes / (4 * dim) / max(n, 1))
    some = points.where(F.pmod(F.xxhash64("vec"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("vec").orderBy("vec").collect()
    sample = np.frombuffer(b"".join(r["vec"] for r in some), np.int32).reshape(-1, dim)
    upper = Upper.placed(np.unique(sample, axis=0), min(params.cells_max, -(-n // params.cell)))
    bare = spark.sparkContext.broadcast(upper)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = bare.value.cells_of(vectors_of(batch, dim).astype(np.float64))
            yield pa.RecordBatch.from_arrays([pa.array(cells), *batch.columns], names=["cell", *batch.schema.names])

    dealt = scratch.save(points.mapInArrow(deal, "cell long, vec binary, label long, ids array<long>"), "dealt")
    scratch.drop(points)
    if upper.root is not None:

        def rows_of(found: dict[int, np.ndarray]) -> pa.RecordBatch:
            cells = sorted(found)
            return pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), *(pa.array([found[c][k].tolist() for c in cells], pa.list_(pa.float64())) for k in (0, 1))], names=["cell", "low", "high"])

        def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, np.ndarray] = {}
            for batch in batches:
                bare.value.ranges(vectors_of(batch, dim).astype(np.float64), batch.column("cell").to_numpy(), found)
            yield rows_of(found)

        def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, np.ndarray] = {}
            for batch in batches:
                for x in batch.to_pylist():
                    merge_ranges(found, x["cell"], np.array([x["low"], x["high"]]))
            yield rows_of(found)

        kind = "cell long, low array<double>, high array<double>"
        ranges = dealt.mapInArrow(measured, kind).repartition("cell").mapInArrow(merged, kind).collect()
        upper.with_ranges({r["cell"]: np.array([r["low"], r["high"]]) for r in ranges})
    size = max(1, params.chunk_bytes // (4 * dim))
    chunks = scratch.save(dealt.groupBy("cell").agg(F.ceil(F.count("*") / size).alias("chunks")), "chunks")
    chunk = F.pmod(F.xxhash64("vec", "label"), F.col("chunks"))
    shards = dealt.join(F.broadcast(chunks), "cell").select(shard(F.col("cell"), chunk).alias("shard"), "vec", "label", "ids")
    return Index(scratch.save(shards, "shards"), chunks, spark.sparkContext.broadcast(upper), params, scratch)


def shard(cell: Column, chunk: Column) -> Column:
    return F.shiftleft(cell, 40) + chunk


ASK = "ask long, anchor_id long, label long, vec binary, least array<long>, most array<long>"
HITS = "ask long, window int, score long, vec_id long"


def routed(index: Index, asks: DataFrame, home: bool) -> DataFrame:
    """A row per query and shard to visit: those of its own cell, or all others that its windows reach."""
    upper = index.upper

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = upper.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = vectors_of(part, tree.dim).astype(np.float64)
                own = tree.cells_of(x)
                if home:
                    who, cells = np.arange(len(x)), own
                else:
                    who, cells = tree.reached(x, lists_of(part, "least").astype(np.float64), lists_of(part, "most").astype(np.float64))
                    who, cells = who[cells != own[who]], cells[cells != own[who]]
                taken = part.take(pa.array(who))
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), *taken.columns], names=["cell", *taken.schema.names])

    sent = asks.mapInArrow(run, f"cell long, {ASK}").join(F.broadcast(index.chunks), "cell")
    return sent.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).withColumn("shard", shard(F.col("cell"), F.col("chunk"))).drop("cell", "chunk", "chunks")


def visited(index: Index, sent: DataFrame, k: int, same: bool) -> DataFrame:
    """The k best rows of each window in each shard a query is sent to: a shard's points come first, then its queries stream past."""
    params, dim = index.params, index.dim
    none = lambda kind: F.lit(None).cast(kind)
    points = index.points.select("shard", F.lit(0).alias("kind"), none("long").alias("ask"), none("long").alias("anchor_id"), "label", "vec", none("array<long>").alias("least"), none("array<long>").alias("most"), "ids")
    queries = sent.select("shard", F.lit(1).alias("kind"), "ask", "anchor_id", "label", "vec", "least", "most", none("array<long>").alias("ids"))
    stream = points.unionByName(queries).repartition("shard").sortWithinPartitions("shard", "kind")

    def answered(chunk: Chunk, part: pa.RecordBatch) -> pa.RecordBatch:
        x, label = vectors_of(part, dim), part.column("label").to_numpy()
        i, w, s, r = chunk.search(x, label, lists_of(part, "least"), lists_of(part, "most"), k, same)
        anchors, square = part.column("anchor_id").to_numpy(), np.einsum("ij,ij->i", x.astype(np.float64), x.astype(np.float64))
        own = (s == square[i]) & (chunk.square[r] == square[i]) if same else np.zeros(len(s), bool)
        rows = []
        for i_, w_, s_, r_, own_ in zip(i.tolist(), w.tolist(), s.tolist(), r.tolist(), own.tolist(), strict=True):
            ids = chunk.ids[r_]
            if own_ and anchors[i_] in ids:  # the same vector and label: one of these rows is the query itself
                ids = ids.copy()
                ids.remove(anchors[i_])
            rows += [(i_, w_, -s_, id_) for id_ in ids[:k]]
        rows.sort()
        kept, last, n = [], None, 0
        for x_ in rows:
            n = n + 1 if x_[:2] == last else 1
            last = x_[:2]
            if n <= k:
                kept.append(x_)
        columns = list(zip(*kept, strict=True)) or [()] * 4
        ask = part.column("ask").take(pa.array(columns[0], pa.int64()))
        return pa.RecordBatch.from_arrays([ask, pa.array(columns[1], pa.int32()), pa.array([-s_ for s_ in columns[2]], pa.int64()), pa.array(columns[3], pa.int64())], names=["ask", "window", "score", "vec_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, chunk = None, [], None
        for batch in batches:
            place, kind = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero((place[1:] != place[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if place[a] != now:
                    now, held, chunk = place[a], [], None
                part = batch.slice(a, b - a)
                if kind[a] == 0:
                    held.append((vectors_of(part, dim), part.column("label").to_numpy(), part.column("ids").to_pylist()))
                    continue
                if chunk is None:
                    x, labels, ids = zip(*held, strict=True)
                    chunk, held = Chunk(np.concatenate(x), np.concatenate(labels), [y for z in ids for y in z], params), []
                for at in range(0, part.num_rows, 256):
                    yield answered(chunk, part.slice(at, 256))

    return stream.mapInArrow(run, HITS)


def searched(index: Index, asks: DataFrame, k: int, same: bool) -> DataFrame:
    """ask, window, rank, vec_id, score: the k best rows of every window, ties to the smaller id."""
    order = Window.partitionBy("ask", "window").orderBy(F.desc("score"), "vec_id")
    scratch = index.scratch
    first = scratch.save(visited(index, routed(index, asks, home=True), k, same), "first")
    bounds = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k)
    bounds = bounds.groupBy("ask").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("bounds"))
    raised = F.transform("least", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("bounds", i), x)))
    closer = asks.join(bounds, "ask", "left").withColumn("least", F.when(F.col("bounds").isNull(), F.col("least")).otherwise(raised)).drop("bounds")
    rest = visited(index, routed(index, closer, home=False), k, same)
    best = first.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return scratch.save(best, "best")


def mined(rows: DataFrame, anchor: Column, params: HardNegatives = HardNegatives()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows that ``anchor`` marks.

    ``rows``: vec_id, label, embedding. Rows with a null id or label, a null vector, or a null or non-finite component
    take no part. Components become floor(scale * x), clamped to 2^23 either way; shorter vectors are filled up with 0.
    Rows that repeat an id are rows like others (an anchor is never its own positive); an empty table, and anchors
    without another row of their label, give no rows. Extra columns are ignored.
    """
    scratch = Scratch(rows.sparkSession)
    whole, dim = quantised(rows.select("vec_id", "label", "embedding"), params)
    whole = scratch.save(whole, "vectors")
    index = indexed(whole, dim, params, scratch)
    every = lambda x: F.array(F.lit(x).cast("long"))
    asks = whole.where(anchor).select(F.monotonically_increasing_id().alias("ask"), F.col("vec_id").alias("anchor_id"), "label", "vec", every(-FAR).alias("least"), every(FAR).alias("most"))
    asks = scratch.save(asks, "asks")
    positives = searched(index, asks, params.positives, same=True)
    # one window a positive, in order; anchors with fewer positives have windows that nothing meets
    per = positives.groupBy("ask").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("p"))
    score = lambda i: F.get("p", i)["score"].cast("decimal(20,0)")
    places = [F.lit(i) for i in range(params.positives)]
    least = F.array(*(F.coalesce(F.ceil(score(i) * params.low / 100).cast("long"), F.lit(1).cast("long")) for i in places))
    most = F.array(*(F.coalesce(F.floor(score(i) * params.high / 100).cast("long"), F.lit(0).cast("long")) for i in places))
    again = asks.drop("least", "most").join(per, "ask").select("ask", "anchor_id", "label", "vec", least.alias("least"), most.alias("most"))
    negatives = searched(index, scratch.save(again, "asks_again"), params.negatives, same=False)
    chosen = positives.select("ask", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = negatives.select("ask", "window", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = out.join(chosen, ["ask", "window"]).join(asks.select("ask", "anchor_id"), "ask")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
