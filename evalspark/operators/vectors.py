"""Vector store, similarity search and diversity of embeddings.

A store is a table: sample_id, content, metadata (map), embedding (array of floats), ts. Parquet holds it; every
function returns a new table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions.text import safe_id
from evalspark.operators import balls


def embedded(rows: DataFrame, text: str, embed: Callable[[pd.Series], list], dim: int, batch_rows: int = 256) -> DataFrame:
    """rows with an embedding from a batch function (a model or a service), and whether it ``failed``: a text that fails
    gets the zero vector. The function gets ``batch_rows`` texts at most; no more are Python objects at a time."""
    columns = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, batch_rows):
                part = batch.slice(at, batch_rows)
                texts = part.column(text).to_pandas()
                try:
                    vectors = list(embed(texts))
                except Exception:  # a batch that fails as a whole is tried row by row
                    vectors = []
                    for i in range(len(texts)):
                        try:
                            vectors.append(list(embed(texts.iloc[i : i + 1]))[0])
                        except Exception:
                            vectors.append(None)
                failed = [v is None or len(v) != dim for v in vectors]
                filled = [[0.0] * dim if f else [float(x) for x in v] for v, f in zip(vectors, failed, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(filled, pa.list_(pa.float32())), pa.array(failed, pa.bool_())], names=[*columns, "embedding", "failed"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, embedding array<float>, failed boolean")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def hashed_embedding(text: Column, dim: int) -> Column:
    """A unit vector of hashed words, as an expression: for tests and stores without a model."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    slots = F.transform(words, lambda w: F.struct(F.pmod(F.xxhash64(w), F.lit(dim)).cast("int").alias("at"), F.when(F.pmod(F.xxhash64(w, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("sign")))
    raw = lambda s: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.aggregate(s, F.lit(0.0), lambda a, x: a + F.when(x["at"] == i, x["sign"]).otherwise(0.0)))
    norm = lambda r: F.sqrt(F.aggregate(r, F.lit(0.0), lambda a, x: a + x * x))
    unit = lambda r: bound(norm(r), lambda n: F.transform(r, lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0))))
    return bound(slots, lambda s: bound(raw(s), unit))


def insert_text(metadata: Column) -> Column:
    """``k: v`` lines by sorted key, without a line end behind the last."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(metadata)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def query_text(metadata: Column) -> Column:
    """``k: v`` lines in the given order, each with a line end."""
    return F.array_join(F.transform(F.map_entries(metadata), lambda e: F.concat(e["key"], F.lit(": "), e["value"], F.lit("\n"))), "")


def added(store: DataFrame, new: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """(store, rejected with a reason): ids are made safe; known or repeated ids and wrong dimensions are rejected."""
    new = new.withColumn("sample_id", safe_id(F.col("sample_id")))
    known = store.select("sample_id", F.lit(True).alias("known"))
    again = F.row_number().over(Window.partitionBy("sample_id").orderBy("ord"))
    judged = new.withColumn("again", again).join(known, "sample_id", "left")
    reason = F.when(F.col("known") | (F.col("again") > 1), "exists").when(F.size("embedding") != dim, "dimension")
    judged = judged.withColumn("reason", reason)
    good = judged.where("reason is null").select(*store.columns)
    return store.unionByName(good), judged.where("reason is not null").select("sample_id", "reason")


def got(store: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows with the given ids, which are made safe first."""
    return store.join(ids.select(safe_id(F.col("sample_id")).alias("sample_id")).distinct(), "sample_id", "left_semi")


def listed(store: DataFrame, limit: int | None = None, benchmark: str | None = None) -> DataFrame:
    """Rows by id, the first ``limit`` of them, of one benchmark if asked for."""
    rows = store if benchmark is None else store.where(F.try_element_at("metadata", F.lit("benchmark")) == benchmark)
    rows = rows.orderBy("sample_id")
    return rows if limit is None else rows.limit(limit)


def counted(store: DataFrame) -> DataFrame:
    return store.agg(F.count("*").alias("n"))


def deleted(store: DataFrame, ids: DataFrame) -> DataFrame:
    return store.join(ids.select(safe_id(F.col("sample_id")).alias("sample_id")), "sample_id", "left_anti")


def with_metadata(store: DataFrame, changes: DataFrame, replace: bool = False) -> tuple[DataFrame, DataFrame]:
    """(store, found per change): metadata merged (new keys win) or replaced; vectors stay."""
    new = changes.select(safe_id(F.col("sample_id")).alias("sample_id"), F.col("metadata").alias("change"))
    old = F.map_filter("metadata", lambda k, v: ~F.coalesce(F.map_contains_key("change", k), F.lit(False)))
    merged = F.col("change") if replace else F.map_concat(old, "change")
    out = store.join(new, "sample_id", "left").withColumn("metadata", F.when(F.col("change").isNull(), F.col("metadata")).otherwise(merged)).select(*store.columns)
    return out, new.join(store.select("sample_id", F.lit(True).alias("found")), "sample_id", "left").select("sample_id", F.coalesce("found", F.lit(False)).alias("found"))


def imported(store: DataFrame, other: DataFrame, overwrite: bool = False) -> DataFrame:
    """Another store in place of this one, or merged with its rows winning; merging needs one dimension."""
    if overwrite:
        return other
    same = F.when(F.size("embedding") == F.col("dim"), F.col("embedding")).otherwise(F.raise_error(F.lit("dimensions differ")).cast("array<float>"))
    dim = store.agg(F.max(F.size("embedding")).alias("dim"))
    checked = other.join(F.broadcast(dim), F.lit(True)).withColumn("embedding", F.when(F.col("dim").isNull(), F.col("embedding")).otherwise(same)).select(*store.columns)
    return store.join(other.select("sample_id"), "sample_id", "left_anti").unionByName(checked)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision, 0 with a zero vector."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def find_similar(store: DataFrame, queries: DataFrame, top_n: int | None, threshold: float = 0.0, sizes: balls.Sizes = balls.Sizes()) -> DataFrame:
    """query_id, rank, sample_id, similarity: exact search of stated queries over every row of the store with a vector.

    The store is indexed by balls. What a query's n-th best row reaches at least is known from the index's sample; it
    visits the balls whose bound is that high, and keeps its best ``top_n`` of each; a window merges them. Without
    ``top_n`` every row at the threshold or above comes back, without a rank. Similarities that agree to 12 places are
    ties, which go to the smaller id.
    """
    index = balls.indexed(store.select("sample_id", "embedding"), "sample_id", sizes)
    asks = index.tables.save(balls.as_bytes(queries.withColumnRenamed("query_id", "ask"), "ask"), "asks")
    near = hits(index, asks, top_n, threshold).withColumnRenamed("ask", "query_id").withColumnRenamed("id", "sample_id")
    if top_n is None:
        return near
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "sample_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= top_n)


def least_of(top_n: int | None, threshold: float) -> Callable[[balls.Centres, np.ndarray], np.ndarray]:
    """A bound of the hits that matter: the threshold, or what the top_n-th best is known to reach."""
    return lambda c, u: np.full(len(u), threshold) if top_n is None else np.maximum(threshold, c.at_least(u, top_n))


def hits(index: balls.Balls, asks: DataFrame, top_n: int | None, threshold: float) -> DataFrame:
    """ask, id, similarity: the best ``top_n`` of every shard that a query visits, or all at the threshold."""
    kinds = f"ask {asks.schema['ask'].dataType.simpleString()}, id {index.points.schema['id'].dataType.simpleString()}, similarity double"

    def answer(ids: pa.Array, v: np.ndarray, part: pa.RecordBatch, u: np.ndarray) -> pa.RecordBatch:
        sim = np.round(u @ v.T, 12)
        low = np.maximum(threshold, part.column("least").to_numpy() - 1e-9)
        if top_n is not None and len(ids) > top_n:  # the best ones, and all that tie with the last of them
            low = np.maximum(low, np.partition(sim, len(ids) - top_n, axis=1)[:, len(ids) - top_n])
        who, what = np.nonzero(sim >= low[:, None])
        found = pa.RecordBatch.from_arrays([part.column("ask").take(pa.array(who)), ids.take(pa.array(what)), pa.array(sim[who, what])], names=["ask", "id", "similarity"])
        if top_n is None or len(who) <= top_n * len(u):
            return found
        order = pa.Table.from_batches([found.append_column("row", pa.array(who))]).sort_by([("row", "ascending"), ("similarity", "descending"), ("id", "ascending")])
        row = order.column("row").to_numpy()
        first = np.searchsorted(row, row)  # where the rows of the same query begin
        kept = order.filter(pa.array(np.arange(len(row)) - first < top_n)).select(["ask", "id", "similarity"])
        return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in kept.columns], names=kept.column_names)

    return balls.visited(index, balls.routed(index, asks, least_of(top_n, threshold)), answer, kinds)


def with_earlier(vectors: DataFrame, threshold: float, sizes: balls.Sizes = balls.Sizes()) -> DataFrame:
    """sample_id of the vectors that are similar, at the threshold or above, to one with a smaller sample_id.

    An exact similarity join with pruning: vectors first meet their own ball, where most find an earlier one; those that
    do not visit the other balls that may reach the threshold and hold an earlier id. Balls too far away for a vector
    never meet it. Thresholds of 0 or less let zero vectors in, as their similarity is 0.
    """
    index = balls.indexed(vectors.select("sample_id", "embedding"), "sample_id", sizes)
    asks = index.points.select(F.col("id").alias("ask"), "vec")
    kind = vectors.schema["sample_id"].dataType.simpleString()

    def answer(ids: pa.Array, v: np.ndarray, part: pa.RecordBatch, u: np.ndarray) -> pa.RecordBatch:
        own, before = part.column("ask").to_numpy(zero_copy_only=False), ids.to_numpy(zero_copy_only=False)
        hit = ((u @ v.T >= threshold) & (before[None, :] < own[:, None])).any(1)
        return pa.RecordBatch.from_arrays([part.column("ask").filter(pa.array(hit))], names=["ask"])

    least = least_of(None, threshold)
    first = index.tables.save(balls.visited(index, balls.routed(index, asks, least, "own"), answer, f"ask {kind}").distinct(), "found")
    open_ = asks.join(first, "ask", "left_anti")
    rest = balls.visited(index, balls.routed(index, open_, least, "other").where("first < ask"), answer, f"ask {kind}")
    return first.unionByName(rest).distinct().withColumnRenamed("ask", "sample_id")


def similarity_pairs(vectors: DataFrame, key: str, block: int = 1024) -> DataFrame:
    """a, b, similarity of every pair a <= b with one ``key`` (a set such as one generation): norms get 1e-8.

    The whole matrix is the result, so its rows are quadratic in a key's vectors. A key's vectors are dealt to blocks of
    about ``block`` by the hash of their id, and every two blocks meet in a group of their own: a task holds two blocks and
    a product of their rows at a time, and a vector is sent as often as its key has blocks.
    """
    of_key = F.ceil(F.count("*").over(Window.partitionBy("key")) / block)
    rows = vectors.where(F.col(key).isNotNull() & F.col("vec_id").isNotNull())
    rows = rows.select(F.col(key).alias("key"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("e"))
    dealt = rows.withColumn("blocks", of_key).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    sent = dealt.withColumn("other", other).select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "id", "e")
    kind, side = (rows.schema[c].dataType.simpleString() for c in ("key", "id"))

    def unit(part: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Unit vectors, and their lengths: of what is null or holds a null, one that no other has."""
        raw = part.column("e").to_pylist()
        size = np.array([-1 if e is None or None in e else len(e) for e in raw])
        x = np.zeros((len(raw), width))
        for i in np.flatnonzero(size > 0):
            x[i, : size[i]] = raw[i]
        return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8), size

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(list(batches)).combine_chunks()
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        left = group.filter(pc.equal(group.column("own"), low))
        right = left if low == high else group.filter(pc.equal(group.column("own"), high))
        if not left.num_rows or not right.num_rows:
            return
        width = pc.max(pc.list_value_length(group.column("e"))).as_py() or 0
        (u, m), (v, n) = unit(left, width), unit(right, width)
        x, y = (part.column("id").combine_chunks() for part in (left, right))
        # places of both sides' ids in one order, equal ones alike
        rank = np.unique(np.concatenate([x.to_numpy(zero_copy_only=False), y.to_numpy(zero_copy_only=False)]), return_inverse=True)[1]
        first, second = rank[: len(x)], rank[len(x) :]
        for at in range(0, len(u), 64):
            sim = u[at : at + 64] @ v.T
            ahead = first[at : at + 64, None] <= second[None, :]
            i, j = np.nonzero(ahead if low == high else np.ones_like(ahead))
            alone = (m[i + at] != n[j]) | (m[i + at] < 0)
            mine, theirs, swap = x.take(pa.array(i + at)), y.take(pa.array(j)), pa.array(~ahead[i, j])
            a, b = pc.if_else(swap, theirs, mine), pc.if_else(swap, mine, theirs)
            label = group.column("key").combine_chunks().take(pa.array(np.zeros(len(i), int)))
            yield pa.RecordBatch.from_arrays([label, a, b, pa.array(sim[i, j], mask=alone)], names=["key", "a", "b", "similarity"])

    found = sent.groupBy("key", "low", "high").applyInArrow(multiply, f"key {kind}, a {side}, b {side}, similarity double")
    return found.withColumnRenamed("key", key)


def gram_entropy(rows: DataFrame, key: str, q: float) -> DataFrame:
    """key, n, score: the Vendi score of order q of each group of vectors.

    The eigenvalues of the n x n similarity matrix over n are those of the d x d matrix of outer products over n, which
    partial sums build; only that small matrix is solved.
    """
    parts = grams(rows.select(F.col(key).alias("key"), "embedding", F.lit(1).alias("sign")))
    return vendi(parts.groupBy("key", "cell").agg(F.sum("x").alias("x"), F.sum("n").alias("n")), q).withColumnRenamed("key", key)


def grams(rows: DataFrame) -> DataFrame:
    """key, cell, x, n: for each task and key the sum of the vectors' outer products by sign, cell by cell, and of signs.

    ``rows``: key, embedding, sign (1 or -1). A task holds one matrix per key that it sees.
    """
    kind = rows.schema["key"].dataType.simpleString()

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            for k, part in batch.groupby("key"):
                x = np.stack(part["embedding"].to_numpy()).astype(float)
                x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-8
                sign = part["sign"].to_numpy()
                gram, n = held.get(k, (0.0, 0))
                held[k] = gram + (x * sign[:, None]).T @ x, n + int(sign.sum())
        for k, (gram, n) in held.items():
            yield pd.DataFrame({"key": [k], "n": [n], "gram": [gram.ravel()]})

    return rows.mapInPandas(partial, f"key {kind}, n long, gram array<double>").select("key", "n", F.posexplode("gram").alias("cell", "x"))


def vendi(cells: DataFrame, q: float) -> DataFrame:
    """key, n, score from the cells (key, cell, x, n) of one matrix per key."""
    whole = cells.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("cell", "x"))).alias("cells"), F.max("n").alias("n")).where("n > 0")
    kind = cells.schema["key"].dataType.simpleString()

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, cells, n in zip(batch["key"], batch["cells"], batch["n"], strict=True):
                d = int(round(len(cells) ** 0.5))
                e = np.linalg.eigvalsh(np.array([c["x"] for c in cells]).reshape(d, d) / n)
                e = e[e > 1e-12]
                out.append((k, n, float(np.exp(-(e * np.log(e)).sum()) if q == 1 else (e**q).sum() ** (1 / (1 - q)))))
            yield pd.DataFrame(out, columns=["key", "n", "score"])

    return whole.select("key", "n", "cells").mapInPandas(solve, f"key {kind}, n long, score double")


def cumulative_entropy(rows: DataFrame, gens: DataFrame, q: float) -> DataFrame:
    """gen, n, score: the Vendi score of all tasks seen up to each generation, each with its last embedding up to then.

    ``rows``: gen, task_number, embedding; ``gens``: gen. A generation adds the outer product of each task that is new or
    has another embedding, and takes away that of the embedding it replaces; running sums of these differences give the
    matrix of every generation. So a row is read once, however many generations follow.
    """
    once = rows.groupBy("gen", "task_number").agg(F.max("embedding").alias("embedding"))
    before = F.lag("embedding").over(Window.partitionBy("task_number").orderBy("gen"))
    steps = once.withColumn("before", before).where("before is null or before <> embedding")
    each = F.array(F.struct("embedding", F.lit(1).alias("sign")), F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("embedding"), F.lit(-1).alias("sign"))))
    changes = grams(steps.select(F.col("gen").alias("key"), F.inline(F.array_compact(each))))
    # every generation has every cell, so that running sums reach it
    cells = steps.agg(F.max(F.size("embedding")).alias("d")).where("d > 0").select(F.explode(F.sequence(F.lit(0), F.col("d") * F.col("d") - 1)).alias("cell"))
    zero = gens.select(F.col("gen").alias("key")).distinct().join(F.broadcast(cells), F.lit(True)).select("key", F.lit(0).cast("long").alias("n"), "cell", F.lit(0.0).alias("x"))
    per = changes.unionByName(zero).groupBy("key", "cell").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    upto = Window.partitionBy("cell").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    found = per.select("key", "cell", F.sum("x").over(upto).alias("x"), F.sum("n").over(upto).alias("n"))
    asked = gens.select(F.col("gen").alias("key")).distinct()
    return vendi(found.join(F.broadcast(asked), "key", "left_semi"), q).withColumnRenamed("key", "gen")


def projected(vectors: DataFrame, clusters: int, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(vec_id, x, y, cluster; plot bounds with 5 % padding): principal components and k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    flat = PCA(k=2, inputCol="v", outputCol="xy").fit(rows).transform(rows)
    labelled = KMeans(k=clusters, featuresCol="v", predictionCol="cluster", seed=seed, maxIter=10).fit(flat).transform(flat)
    xy = vector_to_array("xy")
    out = labelled.select("vec_id", xy[0].alias("x"), xy[1].alias("y"), "cluster")
    pad = lambda c: (F.max(c) - F.min(c)) * 0.05
    return out, out.agg(*((F.min(c) - pad(c)).alias(f"{c}_low") for c in "xy"), *((F.max(c) + pad(c)).alias(f"{c}_high") for c in "xy"))


def solved_by(scores: DataFrame, selection: DataFrame) -> DataFrame:
    """Per task the selected models that solve it, and whether these are none, one or many."""
    names = F.array_sort(F.collect_list(F.when(F.col("solved"), F.col("model_path"))))
    per = scores.join(selection.select("model_path"), "model_path", "left_semi").groupBy("task_number").agg(names.alias("models"))
    return per.withColumn("category", F.when(F.size("models") == 0, "none").when(F.size("models") == 1, "one").otherwise("many"))


def store_statistics(store: DataFrame) -> DataFrame:
    """Counts by benchmark and question type, and distinct subgroups; missing metadata is Unknown."""
    value = lambda k: F.coalesce(F.try_element_at("metadata", F.lit(k)), F.lit("Unknown"))
    rows = store.select(value("benchmark").alias("benchmark"), value("type").alias("type"), value("subgroup").alias("subgroup"))
    return rows.groupBy("benchmark", "type").agg(F.count("*").alias("n"), F.count_distinct("subgroup").alias("subgroups"))


def search_preview(hits: DataFrame, store: DataFrame, benchmark: str | None, top_n: int, preview: int = 300) -> DataFrame:
    """Of 2 * top_n hits those of a benchmark, at most top_n, with the start of their content."""
    rows = hits.where(F.col("rank") <= 2 * top_n).join(store.select("sample_id", "benchmark", "content"), "sample_id")
    rows = rows.where(F.col("benchmark") == benchmark) if benchmark else rows
    again = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return rows.withColumn("place", again).where(F.col("place") <= top_n).select("query_id", "place", "sample_id", "similarity", F.substring("content", 1, preview).alias("preview"))
