"""Dominated-novelty archive update.

``bits``: ord, pos, solved (booleans of one population); ``models``: ord, model_path, fitness. Pairs of models are a
population squared and stay small; tasks may be many, so pairs are aggregated over positions on packed words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.operators.skills import POPULATION_MAX

#: Positions of one packed word.
WORD_BITS = 62


def packed(bits: DataFrame) -> DataFrame:
    """ord, word, solved and seen bits of WORD_BITS positions; a duplicate position is an error."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("pos", F.lit(WORD_BITS)).cast("int"))
    per = bits.groupBy("ord", F.floor(F.col("pos") / WORD_BITS).alias("word")).agg(
        F.bit_or(F.when(F.col("solved"), bit).otherwise(F.lit(0).cast("long"))).alias("solved"), F.bit_or(bit).alias("seen"), F.count("*").alias("n")
    )
    same = F.when(F.bit_count("seen") == F.col("n"), F.col("seen")).otherwise(F.raise_error(F.lit("duplicate position")).cast("long"))
    return per.select("ord", "word", "solved", same.alias("seen"))


def hamming(bits: DataFrame) -> DataFrame:
    """a, b, distance for a < b; vectors of different length are an error."""
    w = packed(bits)
    a, b = (w.select(F.col("ord").alias(x), "word", F.col("solved").alias(f"s{x}"), F.col("seen").alias(f"n{x}")) for x in "ab")
    both = a.join(b, "word").where("a < b")
    equal = F.when(F.col("na") == F.col("nb"), F.bit_count(F.col("sa").bitwiseXOR(F.col("sb")))).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("int"))
    return both.groupBy("a", "b").agg(F.sum(equal).alias("distance"))


def first_fittest(models: DataFrame) -> DataFrame:
    """p: the first place that has the highest fitness."""
    return models.agg((-F.max_by(-F.col("ord"), F.struct("fitness", -F.col("ord")))).alias("p"))


def fitter(models: DataFrame) -> DataFrame:
    """s, f: for each model s the models f that count as fitter.

    Up to the first fittest place these are strictly fitter; behind it, those of equal or higher fitness and another
    path. A theta join of the population with itself, whose size is checked.
    """
    if models.limit(POPULATION_MAX + 1).count() > POPULATION_MAX:
        raise ValueError(f"a population of more than {POPULATION_MAX} models")
    p = first_fittest(models)
    s = models.select(F.col("ord").alias("s"), F.col("fitness").alias("sf"), F.col("model_path").alias("sp")).join(F.broadcast(p), F.lit(True))
    f = models.select(F.col("ord").alias("f"), F.col("fitness").alias("ff"), F.col("model_path").alias("fp"))
    rule = F.when(F.col("s") > F.col("p"), (F.col("ff") >= F.col("sf")) & (F.col("fp") != F.col("sp"))).otherwise(F.col("ff") > F.col("sf"))
    return s.join(f, rule).select("s", "f")


def weighted_sums(bits: DataFrame, weights: DataFrame) -> DataFrame:
    """s, f, num, den, full for all pairs of models: sums of the weights of positions that s solves and f does not, that
    f does not solve, and that both have.

    A position is one row with its models; batches of positions are 0-1 matrices, whose products are summed.
    """
    item = F.collect_list(F.struct("ord", "solved"))
    rows = bits.groupBy("pos").agg(F.transform(item, lambda x: x["ord"]).alias("ords"), F.transform(item, lambda x: x["solved"]).alias("bits")).join(weights, "pos")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = batch["ords"].map(len).to_numpy()
            names, place = np.unique(np.concatenate(batch["ords"].to_numpy()), return_inverse=True)
            seen, solved = (np.zeros((len(batch), len(names))) for _ in range(2))
            row = np.repeat(np.arange(len(batch)), n)
            seen[row, place] = 1
            solved[row, place] = np.concatenate(batch["bits"].to_numpy())
            w, fails = batch["weight"].to_numpy(float)[:, None], seen - solved
            s, f = (x.ravel() for x in np.meshgrid(names, names, indexing="ij"))
            yield pd.DataFrame({"s": s, "f": f, "num": ((solved * w).T @ fails).ravel(), "den": ((seen * w).T @ fails).ravel(), "full": ((seen * w).T @ seen).ravel()})

    parts = rows.select("ords", "bits", "weight").mapInPandas(run, "s long, f long, num double, den double, full double")
    return parts.groupBy("s", "f").agg(*(F.sum(c).alias(c) for c in ("num", "den", "full")))


def pair_ratios(bits: DataFrame, pairs: DataFrame, weights: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """s, f, ratio and ratio_full: 100 * what s solves and f does not, over what f does not solve, or over everything.

    With ``weights`` (pos, weight) both are sums of weights; ``limit`` keeps the first positions only. A denominator
    of 0 gives 0.
    """
    if limit is not None:
        bits = bits.where(F.col("pos") < limit)
        weights = weights.where(F.col("pos") < limit) if weights is not None else None
    if weights is None:
        w = packed(bits)
        s = w.select(F.col("ord").alias("s"), "word", F.col("solved").alias("ss"), "seen")
        f = w.select(F.col("ord").alias("f"), "word", F.col("solved").alias("fs"))
        rows = pairs.join(s, "s").join(f, ["f", "word"])
        free = F.col("seen").bitwiseAND(F.bitwise_not("fs"))
        sums = rows.groupBy("s", "f").agg(
            F.sum(F.bit_count(F.col("ss").bitwiseAND(free))).alias("num"), F.sum(F.bit_count(free)).alias("den"), F.sum(F.bit_count("seen")).alias("full")
        )
    else:
        sums = pairs.join(weighted_sums(bits, weights), ["s", "f"])
    part = lambda d: F.when(F.col(d) > 0, 100.0 * F.col("num") / F.col(d)).otherwise(0.0)
    return sums.select("s", "f", part("den").alias("ratio"), part("full").alias("ratio_full"))


def novelty(models: DataFrame, bits: DataFrame, k: int = 3, dominated: float = 999.0, weights: DataFrame | None = None, full: bool = False, limit: int | None = None) -> DataFrame:
    """models with novelty: the mean of the k smallest pair scores; ``dominated`` without a fitter model or with k = 0."""
    ratios = pair_ratios(bits, fitter(models), weights, limit)
    x = F.col("ratio_full" if full else "ratio")
    few = F.slice(F.array_sort(F.collect_list(x)), 1, max(k, 1))
    mean = F.aggregate(few, F.lit(0.0), lambda a, b: a + b) / F.size(few)
    per = ratios.groupBy(F.col("s").alias("ord")).agg((mean if k else F.lit(dominated)).alias("novelty"))
    return models.join(per, "ord", "left").withColumn("novelty", F.coalesce("novelty", F.lit(dominated)))


def keep_best(rows: DataFrame, score: str, n: int) -> DataFrame:
    """The first n by score, ties by place."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), "ord"))).where(F.col("rank") <= n)


def updated_archive(archive: DataFrame, new: DataFrame, bits: DataFrame, n: int, by_fitness: bool = False, **options) -> DataFrame:
    """Archive and new models together, the most novel (or fittest) n of them."""
    both = archive.unionByName(new)
    return keep_best(both, "fitness", n) if by_fitness else keep_best(novelty(both, bits, **options), "novelty", n)
