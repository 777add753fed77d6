"""Exact maximum coverage by branch and bound.

Positions that the same models solve are one pattern with a weight, so the search sees patterns, not tasks; their number
is checked before they are broadcast. A subtree is a set of chosen models and those that may follow. Its models are tried
by falling gain, and what the largest gains sum to bounds what it can reach. Subtrees are dealt out as tasks, each task
spends a budget and gives back what is still open, and every wave starts with the best value found so far.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.operators.novelty import packed

#: Patterns times models that are searched; a byte each on the driver and in every worker.
CELLS_MAX = 1 << 27
#: Multiplications that a task spends on one subtree in one wave.
BUDGET = 1 << 32


@dataclass
class Patterns:
    """``solved``: patterns x models; ``weight``: positions per pattern; ``ords``: the models' places."""

    solved: np.ndarray
    weight: np.ndarray
    ords: list[int]

    @property
    def nodes(self) -> int:
        """Nodes of a budget."""
        return max(64, BUDGET // max(1, self.solved.size))

    def greedy(self, n: int) -> int:
        left, total = self.weight.copy(), 0.0
        for _ in range(n):
            gains = left @ self.solved
            best = int(gains.argmax())
            total += gains[best]
            left[self.solved[:, best]] = 0
        return int(total)


def patterns(bits: DataFrame, cells: int | None = None) -> Patterns | None:
    """Patterns of a table ord, pos, solved; None if there are too many."""
    cells = CELLS_MAX if cells is None else cells
    ords = [r["ord"] for r in bits.select("ord").distinct().orderBy("ord").collect()]
    names = bits.sparkSession.createDataFrame([(o, i) for i, o in enumerate(ords)], "ord long, place int")
    rows = packed(bits).where("solved <> 0").select("ord", "word", "solved").join(F.broadcast(names), "ord")
    # the bits of a word of positions, a row a position that some model solves
    each = rows.select("word", "place", F.explode(F.sequence(F.lit(0), F.lit(61))).alias("at"), "solved").where(F.call_function("shiftright", "solved", F.col("at")).bitwiseAND(F.lit(1)) == 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place") % 63)
    words = [f"w{w}" for w in range(-(-max(1, len(ords)) // 63))]
    per = each.groupBy("word", "at").agg(*(F.coalesce(F.bit_or(F.when(F.floor(F.col("place") / 63) == i, bit)), F.lit(0).cast("long")).alias(w) for i, w in enumerate(words)))
    most = cells // max(1, len(ords))
    found = per.groupBy(*words).agg(F.count("*").alias("weight")).limit(most + 1).collect()
    if len(found) > most:
        return None
    solved = np.zeros((len(found), len(ords)), bool)
    for i in range(len(ords)):
        solved[:, i] = [r[f"w{i // 63}"] >> (i % 63) & 1 for r in found]
    return Patterns(solved, np.array([r["weight"] for r in found], float), ords)


def explored(p: Patterns, chosen: list[int], free: list[int], n: int, bound: int, stop: int | None, budget: int) -> tuple[int, list[int], list[tuple[list[int], list[int]]]]:
    """(best value above the bound or the bound, its models, open subtrees) of one subtree; ends early at ``stop``."""
    best, models, nodes = bound, [], 0
    stack = [(chosen, np.array(free, int))]
    while stack:
        if nodes >= budget or (stop is not None and best >= stop):
            break
        nodes += 1
        have, may = stack.pop()
        left = np.where(p.solved[:, have].any(1), 0, p.weight) if have else p.weight
        covered, need = p.weight.sum() - left.sum(), n - len(have)
        if need == 0 or len(may) < need:
            if need == 0 and covered > best:
                best, models = int(covered), have
            continue
        gains = left @ p.solved[:, may]
        order = np.argsort(-gains, kind="stable")
        may, gains = may[order], gains[order]
        if need == 1:
            if covered + gains[0] > best:
                best, models = int(covered + gains[0]), [*have, int(may[0])]
            continue
        sums = np.concatenate([[0.0], np.cumsum(gains)])
        reach = np.minimum(covered + sums[need:] - sums[:-need], p.weight.sum())
        last = int(np.searchsorted(-reach, -best, side="left"))  # the first place from which nothing beats the best
        stack += [([*have, int(may[i])], may[i + 1 :]) for i in reversed(range(min(last, len(reach))))]
    return best, models, [(h, m.tolist()) for h, m in stack] if stop is None or best < stop else []


def searched(spark: SparkSession, p: Patterns, chosen: list[int], free: list[int], n: int, bound: int, stop: int | None = None) -> tuple[int, list[int]]:
    """(value, models) of the best n models with ``chosen`` and others out of ``free``, above ``bound``; else (bound, [])."""
    best, models, open_ = explored(p, chosen, free, n, bound, stop, max(1, p.nodes // 8))
    if not open_:
        return best, models
    shared = spark.sparkContext.broadcast(p)
    while open_ and (stop is None or best < stop):
        bound, budget = best, p.nodes

        def run(batches: Iterator[pd.DataFrame], bound=bound, budget=budget) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for h, m in zip(batch["chosen"], batch["free"], strict=True):
                    value, found, rest = explored(shared.value, list(map(int, h)), list(map(int, m)), n, bound, stop, budget)
                    yield pd.DataFrame({"value": [value, *[-1] * len(rest)], "chosen": [found, *(x for x, _ in rest)], "free": [[], *(x for _, x in rest)]})

        # the subtrees nearest to the root are the largest: one row a task, in turn
        table = spark.createDataFrame([(h, m) for h, m in open_], "chosen array<int>, free array<int>")
        parts = table.repartition(min(len(open_), 4 * spark.sparkContext.defaultParallelism)).mapInPandas(run, "value long, chosen array<int>, free array<int>")
        open_ = []
        for r in parts.collect():
            if r["value"] < 0:
                open_.append((list(r["chosen"]), list(r["free"])))
            elif r["value"] > best:
                best, models = r["value"], list(r["chosen"])
    return best, models


def best_cover(spark: SparkSession, p: Patterns, n: int) -> tuple[list[int], int] | None:
    """(places, covered): the n models that cover most, the first in order on ties; None if there are fewer, or none covers.

    First the value. Then place by place the earliest model with which, and with later ones, the value is still reached.
    """
    m = len(p.ords)
    if m < n or n < 1 or not len(p.weight):
        return None
    value, _ = searched(spark, p, [], list(range(m)), n, p.greedy(n) - 1)
    chosen: list[int] = []
    while len(chosen) < n:
        for c in range(chosen[-1] + 1 if chosen else 0, m):
            if searched(spark, p, [*chosen, c], list(range(c + 1, m)), n, value - 1, stop=value)[0] == value:
                chosen.append(c)
                break
    return [p.ords[c] for c in chosen], value
