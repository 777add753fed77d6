"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key; its leading bits are a range bucket inside its source. Sums per (source, bucket)
are small, so their running sums place every bucket, and a window inside each bucket places every document: a
distributed prefix sum in which no task sees a whole source. A source's target is cut at the exact word.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.common import WORD, Scratch


@dataclass(frozen=True)
class Mixing:
    #: Weights given to the sources in code point order, over and over; null comes last.
    weights: tuple[int, ...] = (5, 2, 1)
    #: Size of the mix, as a percentage of all sizes.
    percent: int = 150
    #: Epochs of a source at most.
    epochs: int = 2
    seed: str = "mix"
    #: Hex digits of the key that name a range bucket.
    bucket_digits: int = 3


def targets(sizes: DataFrame, p: Mixing) -> DataFrame:
    """source, source_size, target: shares by weight, no more than ``epochs`` times a source's size.

    A source is full where the level that fills it is at most the common level of the others. Sources sorted by that
    level give the common level as running sums; one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, p.weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(p.weights))) + 1).cast("int"))
    per = per.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * p.epochs)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn(
        "open", F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    total = F.sum("source_size").over(Window.partitionBy()) * p.percent / F.lit(100.0)
    per = per.withColumn("level", (total - F.col("full")) / F.col("open"))
    # the levels rise up to the first source that stays below its cap and fall from there on
    level = F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(Window.partitionBy())
    target = F.least(F.col("cap").cast("double"), F.coalesce(level * F.col("weight"), F.col("cap").cast("double")))
    return per.select("source", "source_size", target.alias("target"))


def mixed(docs: DataFrame, params: Mixing = Mixing()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words the mix takes, repeats counted); and ``text`` and
    ``rest``, the struct that ``docs`` may bring along for its caller.

    Null and empty texts have size 0 and are taken 0 times; null is a source of its own. Sources whose documents are
    all empty have target 0. Equal rows are placed next to each other and may share one place only if they are alike
    in every column that counts, so reruns agree. A row without an id is placed by its text; rows that repeat an id are
    rows like others. Extra columns are ignored.
    """
    p = params
    scratch = Scratch(docs.sparkSession)
    key = F.md5(F.concat_ws("|", F.lit(p.seed), F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    along, order = (["text", "rest"], ["key", "doc_id", "size", F.xxhash64("text")]) if "rest" in docs.columns else ([], ["key", "doc_id", "size"])
    whole = docs.select("doc_id", "source", size.alias("size"), key.alias("key"), *along).withColumn("bucket", F.substring("key", 1, p.bucket_digits))
    rows = scratch.save(whole.select("source", "size", "bucket") if along else whole, "sizes")
    goal = targets(rows, p)
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    place = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "bucket", F.coalesce(F.sum("words").over(place), F.lit(0)).alias("start"))
    g, s = goal.alias("g"), starts.alias("s")
    starts = s.join(g, F.col("s.source").eqNullSafe(F.col("g.source"))).select(F.col("s.source").alias("of"), F.col("s.bucket").alias("in"), "start", "source_size", "target")
    inside = Window.partitionBy("source", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = (whole if along else rows).withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = placed.join(starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("in")))
    budget = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size")).cast("long")).otherwise(F.lit(0))
    left = budget - whole * F.col("source_size") - F.col("start") - F.col("ahead")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *along)
