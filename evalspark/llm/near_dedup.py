"""Near-duplicate grouping: SuperMinHash signatures, banding, exact verification, union-find components.

Every stage is a Spark job over tables that hold one small row per document, bucket member or pair:

1. each document becomes a set of distinct word shingles; equal sets are one *representative* (smallest id),
   so thousands of exact copies cost one row from here on;
2. SuperMinHash signs the sets, bands of the signature become buckets;
3. the most central member of each bucket is compared with the bucket's other members, links are confirmed on whole
   sets, and union-find makes components of them;
4. where buckets then hold several components, all members around a central component are joined by their rarest
   shingles, without a loss. So every pair that shares a bucket is compared, or unlike, or already connected, and a
   group of near copies never emits its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import U64, Scratch, hash_words, join_hashes, list_array, mix, offsets_of, slices, texts_of

EMPTY = np.iinfo(np.uint64).max


@dataclass(frozen=True)
class NearDedup:
    """``bands * rows`` signature slots; a pair of similarity s shares a band with 1 - (1 - s^rows)^bands."""

    shingle_words: int = 5
    percent: int = 80
    bands: int = 36
    rows: int = 6
    seed: int = 7
    #: Members up to which a list of step 4 gives pairs, and expected shingles of one block of longer lists.
    list_rows: int = 64
    block_shingles: int = 1 << 17


def shingle_sets(batch: pa.RecordBatch, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's distinct shingles (sorted), and row offsets. ASCII letters are lower-cased."""
    parts = [t.lower().split() for t in texts_of(batch)]
    n = np.fromiter(map(len, parts), np.int64, len(parts))
    h = hash_words([w for p in parts for w in p])
    at = offsets_of(n)
    row = np.repeat(np.arange(len(parts)), n)
    out, rows = [], []
    if len(h) >= words:
        g = h[: len(h) - words + 1]
        for k in range(1, words):
            g = join_hashes(g, h[k : len(h) - words + 1 + k])
        inside = row[: len(g)] == row[words - 1 :]
        out.append(g[inside])
        rows.append(row[: len(g)][inside])
    for i in np.flatnonzero((n > 0) & (n < words)):  # the whole sequence is the only shingle
        g = h[at[i] : at[i] + 1]
        for k in range(1, n[i]):
            g = join_hashes(g, h[at[i] + k : at[i] + k + 1])
        out.append(g ^ U64(0xA5A5A5A5 + int(n[i])))
        rows.append(np.array([i]))
    if not out:
        return np.zeros(0, U64), np.zeros(len(parts) + 1, np.int64)
    g, r = np.concatenate(out), np.concatenate(rows)
    order = np.lexsort((g, r))
    g, r = g[order], r[order]
    first = np.ones(len(g), bool)
    first[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
    g, r = g[first], r[first]
    return g, offsets_of(np.bincount(r, minlength=len(parts)))


def superminhash(h: np.ndarray, at: np.ndarray, m: int, seed: int) -> np.ndarray:
    """SuperMinHash signatures, one row of ``m`` slots per set (EMPTY throughout for an empty set).

    Element x proposes, for level j = 0, 1, ..., the value j + r_j(x) to slot p_j(x), where p(x) is a random
    permutation built by a partial shuffle. The values of level j are all below those of level j + 1, so a set is
    finished as soon as none of its slots is empty; for large sets that is level 0.
    """
    docs = len(at) - 1
    n = np.diff(at)
    sig = np.full(docs * m, EMPTY, U64)
    doc = np.repeat(np.arange(docs), n)

    def draw(x: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
        y = mix(x + U64((0x9E3779B97F4A7C15 * (j + 1) + seed) % 2**64))
        return y >> U64(32), j + (((y & U64(0xFFFFFFFF)) * U64(m - j)) >> U64(32)).astype(np.int64)

    r, k = draw(h, 0)
    np.minimum.at(sig, doc * m + k, r)
    open_ = np.flatnonzero((n > 0) & (sig.reshape(docs, m) == EMPTY).any(1))
    # a few sets at a time, so that the permutations stay small
    room = np.cumsum(n[open_]) * m // (8 << 20)
    for part in np.split(open_, np.flatnonzero(np.diff(room)) + 1) if len(open_) else []:
        e = np.concatenate([np.arange(at[i], at[i + 1]) for i in part])
        x, d = h[e], doc[e]
        perm = np.tile(np.arange(m, dtype=np.int16), (len(e), 1))
        for j in range(m):
            r, k = draw(x, j)
            i = np.arange(len(x))
            slot = perm[i, k].copy()
            perm[i, k] = perm[:, j]
            perm[:, j] = slot
            if not j:
                continue
            np.minimum.at(sig, d * m + slot, (U64(j) << U64(32)) | r)
            if j < 8 or j % 8 == 0:
                part = part[(sig.reshape(docs, m)[part] == EMPTY).any(1)]
                if not len(part):
                    break
                stay = np.isin(d, part)
                x, d, perm = x[stay], d[stay], perm[stay]
    return sig.reshape(docs, m)


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    s = sig.reshape(len(sig), bands, rows)
    out = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=U64)), s.shape[:2])
    for k in range(rows):
        out = join_hashes(out, s[:, :, k])
    return out


def signatures(docs: DataFrame, p: NearDedup) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the set, and the band buckets (none for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            g, at = shingle_sets(batch, p.shingle_words)
            n = np.diff(at)
            some = n > 0
            sums = [np.zeros(len(n), U64), np.zeros(len(n), U64)]
            for s, salt in zip(sums, (1, 2), strict=True):
                if len(g):
                    s[some] = np.add.reduceat(mix(g ^ mix(np.array([salt], U64))), at[:-1][some])
            bands = band_hashes(superminhash(g, at, p.bands * p.rows, p.seed)[some], p.bands, p.rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), *(pa.array(s.view(np.int64)) for s in sums), list_array(bands.view(np.int64).ravel(), offsets_of(some * p.bands), pa.int64())],
                names=["doc_id", "n_shingles", "set_a", "set_b", "buckets"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, buckets array<long>")


def whole_sets(docs: DataFrame, p: NearDedup) -> DataFrame:
    """rep, shingles: the sets that links are confirmed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            g, at = shingle_sets(batch, p.shingle_words)
            yield pa.RecordBatch.from_arrays([batch.column("rep"), list_array(g.view(np.int64), at, pa.int64())], names=["rep", "shingles"])

    return docs.select("rep", "text").mapInArrow(run, "rep long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b and other columns) some of whose whole sets meet 100 * intersection >= percent * union."""
    a = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    sized = pairs.join(a, "a").join(b, "b").where(100 * F.least(F.size("sa"), F.size("sb")) >= percent * F.greatest(F.size("sa"), F.size("sb")))
    both = F.size(F.array_intersect("sa", "sb"))
    return sized.where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select(*pairs.columns)


def intersections(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, columns: int = 1 << 15) -> np.ndarray:
    """Sizes of the intersections of all sets of ``a`` with all of ``b``, by products of 0-1 matrices a few columns wide."""
    names, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    rows = np.concatenate([np.repeat(np.arange(len(a_at) - 1), np.diff(a_at)), np.repeat(np.arange(len(b_at) - 1), np.diff(b_at))])
    first = np.arange(len(where)) < len(a)
    order = np.argsort(where, kind="stable")
    where, rows, first = where[order], rows[order], first[order]
    out = np.zeros((len(a_at) - 1, len(b_at) - 1), np.float32)
    for lo in range(0, len(names), columns):
        part = slice(*np.searchsorted(where, [lo, lo + columns]))
        w, r, f = where[part] - lo, rows[part], first[part]
        x, y = (np.zeros((n, min(columns, len(names) - lo)), np.float32) for n in out.shape)
        x[r[f], w[f]] = 1
        y[r[~f], w[~f]] = 1
        out += x @ y.T
    return np.rint(out).astype(np.int64)


def late_links(around: DataFrame, sets: DataFrame, p: NearDedup, scratch: Scratch) -> DataFrame:
    """(u, v): components that a confirmed link joins, among the members around each heart.

    ``around``: heart, rep, comp. Two sets that are similar enough share one of their rarest shingles: with shingles in
    one order, here by their frequency among these members, each has a common one among its first (100 - percent) % + 1.
    So members meet in lists by heart and such a shingle; lists of one component, as those of unique shingles, are done.
    Short lists give pairs, long ones are compared block against block.
    """
    mine = sets.join(around.select("rep").distinct(), "rep", "left_semi")
    flat = mine.select("rep", "digest", F.explode("shingles").alias("shingle"))
    often = flat.groupBy("shingle").agg(F.count("*").alias("often"))
    order = F.array_sort(F.collect_list(F.struct("often", "shingle")))
    first = F.slice(order, 1, (F.floor(F.count("*") * (100 - p.percent) / 100) + 1).cast("int"))
    rare = flat.join(often, "shingle").groupBy("rep", "digest").agg(first.alias("first"))
    rare = rare.select("rep", F.explode("first").alias("x")).where("x.often > 1").select("rep", "x.shingle").distinct()
    lists = scratch.save(around.join(rare, "rep").select(F.xxhash64("heart", "shingle").alias("list"), "rep", "comp"), "lists")
    mixed = lists.groupBy("list").agg(F.count("*").alias("members"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    mixed = scratch.save(lists.join(mixed.select("list", "members"), "list"), "mixed")
    few, many = mixed.where(F.col("members") <= p.list_rows), mixed.where(F.col("members") > p.list_rows)
    a, b = (few.select("list", F.col("rep").alias(x), F.col("comp").alias(c)) for x, c in (("a", "u"), ("b", "v")))
    pairs = a.join(b, "list").where("a < b and u <> v").select("a", "b", "u", "v").distinct()
    return confirmed(scratch.save(pairs, "pairs"), sets, p.percent).select("u", "v").union(block_links(many, sets, p)).distinct()


def block_links(lists: DataFrame, sets: DataFrame, p: NearDedup) -> DataFrame:
    """The same for long lists (list, rep, comp): members outside the list's largest component, in blocks, meet all
    members, in blocks; a block gives back no more links than it has members."""
    sizes = lists.groupBy("list", "comp").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("list").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"))
    full = lists.join(largest, "list").join(sets, "rep")
    many = F.size("shingles")
    n = full.groupBy("list").agg(F.sum(F.when(F.col("comp") != F.col("main"), many)).alias("m"), F.sum(many).alias("n"))
    parts = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / p.block_shingles)).cast("int")
    full = full.join(n.select("list", parts("m").alias("few"), parts("n").alias("all")), "list")
    item = F.collect_list(F.struct("rep", "comp", "shingles"))
    place = lambda c: F.pmod(F.xxhash64("rep"), F.col(c)).cast("int")
    left = full.where("comp <> main").groupBy("list", place("few").alias("x")).agg(item.alias("left"))
    right = full.groupBy("list", "few", place("all").alias("y")).agg(item.alias("right"))
    right = right.select("list", F.explode(F.sequence(F.lit(0), F.col("few") - 1)).alias("x"), "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int]] = []
            for left, right in zip(batch.column("left"), batch.column("right"), strict=True):
                sides = []
                for side in (left.values, right.values):
                    sets = side.field("shingles")
                    at = sets.offsets.to_numpy()
                    sides.append((sets.values.to_numpy()[at[0] : at[-1]], at - at[0], side.field("comp").to_numpy()))
                (a, a_at, ca), (b, b_at, cb) = sides
                both = intersections(a, a_at, b, b_at)
                either = np.diff(a_at)[:, None] + np.diff(b_at)[None, :] - both
                i, j = np.nonzero((100 * both >= p.percent * either) & (ca[:, None] != cb[None, :]))
                out += forest(ca[i].tolist(), cb[j].tolist())
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in out], pa.int64()), pa.array([v for _, v in out], pa.int64())], names=["u", "v"])

    return left.join(right, ["list", "x"]).select("left", "right").mapInArrow(run, "u long, v long")


def forest(us: list[int], vs: list[int]) -> list[tuple[int, int]]:
    """Union-find: a star per component of the edges, its smallest node last."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    for u, v in zip(us, vs, strict=True):
        a, b = find(u), find(v)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, r) for x in list(parent) if (r := find(x)) != x]


def local_forest(edges: DataFrame) -> DataFrame:
    """Union-find inside each partition: (u, v) edges become a star per local component, v its smallest node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            star = forest(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in star], pa.int64()), pa.array([r for _, r in star], pa.int64())], names=["u", "v"])

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def relabelled(comp: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """rep, comp after the components that ``edges`` (u, v) name have grown together."""
    root = components(edges, scratch).select(F.col("u").alias("comp"), F.col("v").alias("root"))
    return comp.join(root, "comp", "left").select("rep", F.coalesce("root", "comp").alias("comp"))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v): the smallest node v of u's connected component, for every node u that is not that node itself.

    Large-star and small-star steps alternate over the forest of the local union-finds until nothing changes; each
    step moves every node to its smallest known neighbour by a partial min, so a hot node costs no large group.
    """
    now = scratch.save(local_forest(edges).distinct(), "forest")
    seen = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        after = scratch.save(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "stars")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(now)
        now = after
        if state == seen:
            return now
        seen = state


def near_duplicates(docs: DataFrame, params: NearDedup = NearDedup()) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept: a row for each row.

    Null and empty texts have an empty set, are linked with nothing and kept. Equal texts share a component. Rows with
    one doc_id are one document with several texts: it is linked by any of them, and all its rows have one component.
    Rows without a doc_id are linked with nothing, have no component and are kept. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    p = params
    docs = docs.select("doc_id", "text")
    sig = scratch.save(signatures(docs.where("doc_id is not null"), p), "signatures")
    owner = sig.where("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"))
    copies = scratch.save(
        sig.where("n_shingles > 0").select("doc_id", "n_shingles", "set_a", "set_b").join(owner, ["set_a", "set_b"]).select("doc_id", "n_shingles", "rep"), "copies"
    )
    reps = copies.where("doc_id = rep").select("doc_id").distinct()
    signed = sig.join(reps, "doc_id", "left_semi").dropDuplicates(["doc_id", "set_a", "set_b"])
    rows = scratch.save(signed.select(F.col("doc_id").alias("rep"), F.explode("buckets").alias("bucket")), "buckets")
    shared = rows.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    members = scratch.save(rows.join(shared, "bucket"), "members")
    popular = members.groupBy("rep").agg(F.sum("members").alias("popularity"))
    live = scratch.save(members.join(popular, "rep").select("bucket", "rep", "popularity"), "live")
    scratch.drop(rows, members)
    wanted = live.select("rep").distinct()
    sets = whole_sets(docs.withColumnRenamed("doc_id", "rep").join(wanted, "rep", "left_semi"), p).withColumn("digest", F.xxhash64("shingles"))
    sets = scratch.save(sets.dropDuplicates(["rep", "digest"]), "sets")
    # the most central member of each bucket against the others
    best = live.groupBy("bucket").agg(F.max(F.struct("popularity", (-F.col("rep")).alias("minus"))).alias("best"))
    pivots = scratch.save(best.select("bucket", (-F.col("best.minus")).alias("pivot")), "pivots")
    pairs = live.join(pivots, "bucket").where("rep <> pivot").select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()
    # the texts of one id lead to one component
    own = copies.groupBy("doc_id").agg(F.min("rep").alias("v"), F.max("rep").alias("hi")).where("v < hi").select("doc_id", "v")
    own = copies.join(own, "doc_id").where("rep <> v").select(F.col("rep").alias("u"), "v")
    links = scratch.save(confirmed(pairs, sets, p.percent).select(F.col("a").alias("u"), F.col("b").alias("v")).union(own).distinct(), "links")
    comp = scratch.save(relabelled(wanted.select("rep", F.col("rep").alias("comp")), links, scratch), "components")
    # buckets that still hold several components: members outside the pivot's component against all members
    heart = pivots.join(comp.select(F.col("rep").alias("pivot"), F.col("comp").alias("heart")), "pivot").select("bucket", "heart")
    placed = scratch.save(live.join(comp, "rep").join(heart, "bucket").select("bucket", "rep", "comp", "heart"), "placed")
    open_ = placed.where("comp <> heart").select("bucket").distinct()
    around = scratch.save(placed.join(open_, "bucket", "left_semi").select("heart", "rep", "comp").distinct(), "around")
    late = scratch.save(late_links(around, sets, p, scratch), "late")
    comp = relabelled(comp, late, scratch)
    grouped = copies.join(comp, "rep", "left").select("doc_id", "n_shingles", F.coalesce("comp", "rep").alias("component_id"))
    alone = sig.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    unnamed = signatures(docs.where("doc_id is null"), p).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return grouped.union(alone).union(unnamed).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
