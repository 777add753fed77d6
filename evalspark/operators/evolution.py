"""Reports over generations, lineage and averages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions.hashing import set_digest
from evalspark.functions.text import generation, is_seed_label
from evalspark.sources.tables import Tables

KINDS = ("adaptation_easier", "adaptation_harder", "adaptation_novel")


def solved_share(samples: DataFrame, selection: DataFrame) -> DataFrame:
    """Per generation and sample the share of the generation's selected models that solve it."""
    rows = samples.join(selection.select("gen", "model_name"), ["gen", "model_name"])
    return rows.groupBy("gen", "sample_id").agg(F.avg(F.col("correct").cast("int")).alias("share"), F.count("*").alias("models"))


def adaptation_counts(tasks: DataFrame) -> DataFrame:
    """Tasks by generation type (missing: seed_task), in display order."""
    kind = F.coalesce("generation_type", F.lit("seed_task"))
    order = F.array_position(F.array(*map(F.lit, ("seed_task", "initial", *KINDS))), F.col("kind"))
    return tasks.groupBy(kind.alias("kind")).count().withColumn("place", order)


def first_seen(pools: DataFrame) -> DataFrame:
    return pools.groupBy("task_number").agg(F.min("gen").alias("first_gen"))


def new_and_missing(pools: DataFrame) -> DataFrame:
    """Per generation: tasks never seen before, and tasks seen before that are absent now."""
    gens = pools.select("gen").distinct()
    per = pools.join(first_seen(pools), "task_number").groupBy("gen").agg(F.count_if(F.col("gen") == F.col("first_gen")).alias("new"), F.count("*").alias("active"))
    upto = first_seen(pools).groupBy(F.col("first_gen").alias("gen")).agg(F.count("*").alias("came"))
    ever = gens.join(upto, "gen", "left").withColumn("ever", F.sum(F.coalesce("came", F.lit(0))).over(Window.orderBy("gen")))
    return per.join(ever, "gen").select("gen", "new", (F.col("ever") - F.col("active")).alias("missing"))


def adaptation_types(pools: DataFrame, tasks: DataFrame) -> DataFrame:
    """Per generation and adaptation kind the tasks that first appear there; 0 where there are none."""
    firsts = first_seen(pools).join(tasks.select("task_number", "generation_type"), "task_number")
    per = firsts.where(F.col("generation_type").isin(*KINDS)).groupBy(F.col("first_gen").alias("gen"), F.col("generation_type").alias("kind")).agg(F.count("*").alias("n"))
    grid = pools.select("gen").distinct().withColumn("kind", F.explode(F.array(*map(F.lit, KINDS))))
    return grid.join(per, ["gen", "kind"], "left").select("gen", "kind", F.coalesce("n", F.lit(0)).alias("n"))


def pool_sizes(pools: DataFrame) -> DataFrame:
    """Per generation: active tasks, and distinct tasks so far."""
    active = pools.groupBy("gen").agg(F.count("*").alias("active"))
    came = first_seen(pools).groupBy(F.col("first_gen").alias("gen")).agg(F.count("*").alias("came"))
    so_far = F.sum(F.coalesce("came", F.lit(0))).over(Window.orderBy("gen"))
    return active.join(came, "gen", "left").withColumn("so_far", so_far).select("gen", "active", "so_far")


def averages(results: DataFrame, by: Sequence[str], benchmarks: int | None = None) -> DataFrame:
    """Mean of ``value`` per group over its benchmarks, and per benchmark (grouping sets).

    With ``benchmarks`` a missing benchmark counts as 0, in the mean and in the deviation; else it does not count.
    """
    rows = results.groupBy(*by, "benchmark").agg(F.avg("value").alias("value"))
    if benchmarks is None:
        sets = rows.groupingSets([[*map(F.col, by), F.col("benchmark")], [*map(F.col, by)]], *map(F.col, by), F.col("benchmark"))
        return sets.agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    mean = F.sum("value") / benchmarks
    return rows.groupBy(*by).agg(mean.alias("mean"), F.sqrt(F.greatest(F.sum(F.col("value") * F.col("value")) / benchmarks - mean * mean, F.lit(0.0))).alias("deviation"), F.count("*").alias("n"))


def ancestry(tasks: DataFrame) -> DataFrame:
    """task_number, step, ancestor, rate: the chain from each task to its root (step 0 is the task itself).

    By doubling: what is known of the ancestor ``reach`` steps up continues a task's chain, until no task has one. A task
    that is its own ancestor is an error of the data.
    """
    tables, reach = Tables(tasks.sparkSession), 1
    parts = [tables.save(tasks.select("task_number", F.lit(0).alias("step"), F.col("task_number").alias("ancestor"), F.col("original_pass_rate").alias("rate")), "ancestry")]
    jumps = tables.save(tasks.where("parent_number is not null").select("task_number", F.col("parent_number").alias("up")), "jumps")
    while not jumps.isEmpty():
        above = all_of(parts).withColumnRenamed("task_number", "up")
        more = tables.save(jumps.join(above, "up").select("task_number", (F.col("step") + reach).alias("step"), "ancestor", "rate"), "ancestry")
        if not more.where("ancestor = task_number").isEmpty():
            raise ValueError("a task is its own ancestor")
        parts.append(more)
        reach *= 2
        twice = tables.save(jumps.join(jumps.select(F.col("task_number").alias("up"), F.col("up").alias("next")), "up").select("task_number", F.col("next").alias("up")), "jumps")
        tables.drop(jumps)
        jumps = twice
    return all_of(parts)


def all_of(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def reported_rates(tasks: DataFrame) -> DataFrame:
    """Per parent the pass rates that its children report, in order."""
    rates = F.array_sort(F.collect_list(F.struct("task_number", "original_pass_rate")))
    return tasks.where("parent_number is not null").groupBy("parent_number").agg(F.transform(rates, lambda x: x["original_pass_rate"]).alias("rates"))


def lineage(edges: DataFrame, models: DataFrame) -> DataFrame:
    """child, ancestor: all ancestors of the given models (column child), each pair once; cycles are no harm.

    By doubling: a pair at most 2^k steps apart and a pair exactly 2^k steps apart make one at most 2^(k+1) apart. What a
    round finds anew is a table of its own, so every pair is written once, and a chain of a thousand takes ten rounds.
    """
    tables = Tables(edges.sparkSession)
    exact = tables.save(edges.select("child", F.col("parent").alias("ancestor")).distinct(), "exact")
    parts = [tables.save(exact.join(models.select("child"), "child", "left_semi"), "lineage")]
    while True:
        found = all_of(parts)
        up = found.join(exact.select(F.col("child").alias("ancestor"), F.col("ancestor").alias("top")), "ancestor").select("child", F.col("top").alias("ancestor")).distinct()
        more = tables.save(up.join(found, ["child", "ancestor"], "left_anti"), "lineage")
        if more.isEmpty():
            tables.drop(more, exact)
            return found
        parts.append(more)
        twice = tables.save(exact.join(exact.select(F.col("child").alias("ancestor"), F.col("ancestor").alias("top")), "ancestor").select("child", F.col("top").alias("ancestor")).distinct(), "exact")
        tables.drop(exact)
        exact = twice


def task_tree(pools: DataFrame, tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: task_number, gen; edges: parent, child, gen). Parents outside every pool are seeds of generation -1.

    Edges come from generations that another non-empty one follows: a task that first came in the last has no children.
    """
    nodes = first_seen(pools).withColumnRenamed("first_gen", "gen")
    edges = tasks.where("parent_number is not null").join(nodes, "task_number").select(F.col("parent_number").alias("parent"), F.col("task_number").alias("child"), "gen")
    last = nodes.groupBy("gen").agg(F.count("*").alias("n")).agg(F.max("gen").alias("gen"))
    late = nodes.join(F.broadcast(last), "gen").select(F.col("task_number").alias("parent"))
    edges = edges.join(late, "parent", "left_anti")
    seeds = edges.select(F.col("parent").alias("task_number")).distinct().join(nodes, "task_number", "left_anti").withColumn("gen", F.lit(-1).cast("bigint"))
    return nodes.select("task_number", F.col("gen").cast("bigint").alias("gen")).unionByName(seeds), edges


def model_tree(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: model, gen, is_seed; edges: parent, child) of a table of parents.

    Nodes are all children and parents; seeds have generation -1. An edge needs a parent that is a child itself or a seed.
    """
    names = edges.select(F.col("child").alias("model")).union(edges.select("parent")).distinct()
    seed = is_seed_label(F.col("model"))
    nodes = names.select("model", F.when(seed, F.lit(-1)).otherwise(generation(F.col("model"))).cast("bigint").alias("gen"), seed.alias("is_seed"))
    known = edges.select(F.col("child").alias("parent")).union(nodes.where("is_seed").select(F.col("model").alias("parent"))).distinct()
    return nodes, edges.join(known, "parent", "left_semi").select("parent", "child")


def change_points(pools: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(generations whose task set differs from the one before, step: third change less the second).

    Sets are compared by digests that partial aggregation merges; a row per generation is left.
    """
    sets = pools.select("gen", "task_number").distinct().groupBy("gen").agg(set_digest("task_number").alias("tasks"))
    before = F.lag("tasks").over(Window.orderBy("gen"))
    changes = sets.withColumn("before", before).where("before is null or before <> tasks").select("gen", F.row_number().over(Window.orderBy("gen")).alias("change"))
    at = lambda k: F.max(F.when(F.col("change") == k, F.col("gen")))
    return changes, changes.agg((at(3) - at(2)).alias("step"))


def group_scores(groups: DataFrame, prefix: str, judge: bool) -> DataFrame:
    """Scores of the benchmark's groups per model, without the prefix; judged and plain files apart."""
    kind = F.contains("file", F.lit("llm_as_a_judge"))
    return groups.where(kind if judge else ~kind).select("model_name", F.regexp_replace("group", f"^{prefix}_?", "").alias("group"), "value")


def scaling_table(results: DataFrame) -> DataFrame:
    """benchmark, n, gen (from the method's name), value; and the mean over benchmarks as benchmark ``average``."""
    gen = F.regexp_extract("method", r"gen_?(\d+)", 1).try_cast("bigint")
    rows = results.withColumn("gen", gen).select("benchmark", "n", "gen", "value")
    return rows.unionByName(rows.groupBy("n", "gen").agg(F.avg("value").alias("value")).withColumn("benchmark", F.lit("average")))


def wide_shares(selected: DataFrame, by: Sequence[str], models: Sequence[str]) -> DataFrame:
    """Per (by) the share of each model among the rows, a column per model, 0 where it has none."""
    total = selected.groupBy(*by).agg(F.count("*").alias("n"), *(F.count_if(F.col("model_name") == m).alias(m) for m in models))
    return total.select(*by, *((F.col(m) / F.col("n")).alias(m) for m in models))


def unpivoted(results: DataFrame, ids: Sequence[str], values: Sequence[str]) -> DataFrame:
    return results.unpivot(list(ids), list(values), "metric", "value")


def is_interval(gen: Column, interval: int, zero: bool) -> Column:
    return (F.pmod(gen, F.lit(interval)) == 0) & ((gen > 0) | F.lit(zero))
