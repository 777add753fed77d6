"""Selection of model subsets.

``skills``: (group columns,) ord, model_path, task_number, score. A group (such as a generation) is selected on its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.operators import cover_search
from evalspark.operators.novelty import packed
from evalspark.sources.tables import Tables

#: Subsets that an exhaustive search tries at most.
SUBSETS_MAX = 2_000_000


def greedy_cover(skills: DataFrame, n: int, by: Sequence[str] = (), include: Sequence[str] | None = (), is_seed: Column | None = None) -> DataFrame:
    """(by, pick, ord, model_path, gain): ``n`` times the model that covers most tasks not covered yet.

    Ties, and picks that gain nothing, go to the earliest unused place; a score that is not 0 covers. ``include``: paths
    that come first, in archive order, at most n of them; None bars seeds (``is_seed``). If models run out, the last
    pick is repeated. One job per pick, each over the uncovered rows only.
    """
    by = list(by)
    tables = Tables(skills.sparkSession)
    if include is None and is_seed is not None:
        skills = skills.where(~is_seed)
    models = tables.save(skills.select(*by, "ord", "model_path").distinct(), "models")
    left = tables.save(skills.where("score <> 0").select(*by, "ord", "task_number").distinct(), "left")
    forced = models.where(F.col("model_path").isin(list(include or [])))
    forced = forced.withColumn("pick", F.row_number().over(Window.partitionBy(*by).orderBy("ord"))).where(F.col("pick") <= n)
    picked, used = [], models.limit(0).select(*by, "ord")
    for pick in range(1, n + 1):
        gains = left.groupBy(*by, "ord").agg(F.count("*").alias("gain"))
        free = models.join(used, [*by, "ord"], "left_anti") if picked else models
        scored = free.join(gains, [*by, "ord"], "left").withColumn("gain", F.coalesce("gain", F.lit(0)))
        must = forced.where(F.col("pick") == pick).select(*by, F.col("ord").alias("must"))
        scored = scored.join(must, by, "left") if by else scored.join(must, F.lit(True), "left")
        best = F.max_by(F.struct("ord", "model_path", "gain"), F.struct(F.coalesce(F.col("ord") == F.col("must"), F.lit(False)), "gain", -F.col("ord")))
        now = tables.save(scored.groupBy(*by).agg(best.alias("b")).where("b is not null").select(*by, F.lit(pick).alias("pick"), "b.*"), "pick")
        picked.append(now)
        used = used.union(now.select(*by, "ord"))
        taken = left.join(now.select(*by, "ord"), [*by, "ord"], "left_semi").select(*by, "task_number")
        fewer = tables.save(left.join(taken, [*by, "task_number"], "left_anti"), "left")
        tables.drop(left)
        left = fewer
    tables.drop(left, models)
    out = picked[0]
    for more in picked[1:]:
        out = out.union(more)
    last = out.groupBy(*by).agg(F.max_by(F.struct("pick", "ord", "model_path"), "pick").alias("l")).where(F.col("l.pick") < n)
    repeat = last.select(*by, F.explode(F.sequence(F.col("l.pick") + 1, F.lit(n))).alias("pick"), "l.ord", "l.model_path", F.lit(0).cast("long").alias("gain"))
    return out.union(repeat)


def optimal_cover(bits: DataFrame, n: int) -> DataFrame:
    """members (places), covered: the n-subset that covers most positions, the first in order on ties; none if none covers.

    Branch and bound over patterns of solvers; if there are too many patterns to broadcast, every subset is tried.
    """
    found = cover_search.patterns(bits)
    if found is None:
        return every_subset(bits, n)
    best = cover_search.best_cover(bits.sparkSession, found, n)
    return bits.sparkSession.createDataFrame([best] if best else [], "members array<bigint>, covered bigint")


def every_subset(bits: DataFrame, n: int) -> DataFrame:
    """The same by trying all: subsets grow by joins on increasing places over packed words; more than SUBSETS_MAX is an error."""
    w = packed(bits).select("ord", "word", "solved")
    count = w.select("ord").distinct().count()
    if comb(count, n) > SUBSETS_MAX:
        raise ValueError(f"{comb(count, n)} subsets; at most {SUBSETS_MAX} are tried")
    sets = w.select(F.array("ord").alias("members"), "word", F.col("solved").alias("any"))
    for _ in range(n - 1):
        more = sets.join(w, "word").where(F.col("ord") > F.element_at("members", -1))
        sets = more.select(F.array_append("members", F.col("ord")).alias("members"), "word", F.col("any").bitwiseOR(F.col("solved")).alias("any"))
    covered = sets.groupBy("members").agg(F.sum(F.bit_count("any")).alias("covered")).where("covered > 0")
    order = F.struct("covered", F.transform("members", lambda m: -m))
    return covered.agg(F.max_by(F.struct("members", "covered"), order).alias("b")).where("b is not null").select("b.*")


def top_n(models: DataFrame, n: int, by: Sequence[str] = (), score: str = "fitness") -> DataFrame:
    """The first n by score, ties by place, with their rank. Models of several archives may recur."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), *(["gen"] if "gen" in models.columns and "gen" not in by else []), "ord"))
    return models.withColumn("rank", rank).where(F.col("rank") <= n)


def random_n(models: DataFrame, n: int, draw: Column, root: str | None = None) -> DataFrame:
    """The first row of each path, in random order, n of them; ``root`` rebases the paths."""
    first = models.withColumn("again", F.row_number().over(Window.partitionBy("model_path").orderBy("ord"))).where("again = 1").drop("again")
    few = first.withColumn("rank", F.row_number().over(Window.orderBy(draw, "ord"))).where(F.col("rank") <= n)
    return few.withColumn("model_path", F.concat(F.lit(root.rstrip("/") + "/"), F.substring_index("model_path", "/", -1))) if root else few


def adjusted_fitness(models: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), max_gen: int | None = None) -> DataFrame:
    """Fitness for a selection over stored skill vectors: included paths come first, excluded ones and later generations go."""
    rows = models.where(~F.col("model_path").isin(list(exclude))) if exclude else models
    rows = rows.where(F.col("gen") <= max_gen) if max_gen is not None else rows
    return rows.withColumn("fitness", F.when(F.col("model_path").isin(list(include)), F.lit(float("inf"))).otherwise(F.col("fitness")))


def best_generation(skills: DataFrame, n: int) -> DataFrame:
    """gen, covered, models: the generation whose n greedy picks cover most (the earliest on ties), its models by name."""
    total = greedy_cover(skills, n, by=["gen"]).groupBy("gen").agg(F.sum("gain").alias("covered"))
    best = total.agg(F.max_by(F.struct("gen", "covered"), F.struct("covered", -F.col("gen"))).alias("b")).select("b.*")
    names = skills.join(F.broadcast(best), "gen").select("gen", "covered", "model_path").distinct()
    return names.withColumn("rank", F.row_number().over(Window.orderBy("model_path"))).where(F.col("rank") <= n)


def generation_mix(ranked: DataFrame, gens: Sequence[int], n: int) -> DataFrame:
    """As many models of each generation as it is named in ``gens``, by rank; the total must be n."""
    if len(gens) != n:
        raise ValueError(f"{len(gens)} generations named for {n} models")
    quota = {g: gens.count(g) for g in gens}
    table = ranked.sparkSession.createDataFrame(sorted(quota.items()), "gen long, quota int")
    return ranked.join(F.broadcast(table), "gen").where("rank <= quota").drop("quota")


def seen_tasks(skills: DataFrame, pools: DataFrame, max_gen: int) -> DataFrame:
    """Skill entries whose task was in any pool up to ``max_gen``."""
    return skills.join(pools.where(F.col("gen") <= max_gen).select("task_number"), "task_number", "left_semi")


def union_of(*selections: DataFrame) -> DataFrame:
    """Distinct model names of all selections."""
    names = selections[0].select("model_path")
    for s in selections[1:]:
        names = names.unionByName(s.select("model_path"))
    return names.distinct()


def stored_selection(contributions: DataFrame, method: str, n: int) -> DataFrame:
    """Models of a stored result: those with a contribution."""
    return contributions.where((F.col("method") == method) & (F.col("n") == n)).select("model_name").distinct()
