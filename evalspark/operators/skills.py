"""Skill vectors, fitness, archive metrics and cell archives.

``skills``: ord (place in the archive), model_path, task_number, score. Places decide every tie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.operators.order import placed

MODEL = ("ord", "model_path")
POPULATION_MAX = 10_000


def assemble(results: DataFrame) -> DataFrame:
    """Per model its task -> score map and the mean score; failed evaluations (null score) count as 0."""
    score = F.coalesce("score", F.lit(0.0))
    entry = F.struct("task_number", score.alias("score"))
    return results.groupBy(*MODEL).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("skills"), F.avg(score).alias("quality"), F.count("*").alias("n"))


def fitness(models: DataFrame, skills: DataFrame) -> DataFrame:
    """Mean score of every model, 0 without scores."""
    per = skills.groupBy("ord").agg(F.avg("score").alias("mean"))
    return models.join(per, "ord", "left").select(*models.columns, F.coalesce("mean", F.lit(0.0)).alias("fitness"))


def combined_fitness(task_quality: DataFrame, skill_quality: DataFrame) -> DataFrame:
    """(sum of task qualities + mean skill quality) / (tasks + 1 if there are skills); 0 if there is neither."""
    tasks = task_quality.groupBy("ord").agg(F.sum("quality").alias("total"), F.count("*").alias("tasks"))
    both = tasks.join(skill_quality.select("ord", "quality"), "ord", "full")
    n = F.coalesce("tasks", F.lit(0)) + F.when(F.col("quality").isNotNull(), 1).otherwise(0)
    return both.select("ord", F.coalesce(F.try_divide(F.coalesce("total", F.lit(0.0)) + F.coalesce("quality", F.lit(0.0)), n), F.lit(0.0)).alias("fitness"))


def grid(models: DataFrame, pool: DataFrame, skills: DataFrame) -> DataFrame:
    """Every model against every pool task; a missing score is 0. A population of more than POPULATION_MAX is an error."""
    places = [r["ord"] for r in models.select("ord").distinct().orderBy("ord").limit(POPULATION_MAX + 1).collect()]
    if len(places) > POPULATION_MAX:
        raise ValueError(f"a population of more than {POPULATION_MAX} models")
    tasks = pool.select("task_number", F.explode(F.array(*map(F.lit, places)).cast("array<bigint>")).alias("ord"))
    return tasks.join(skills.select("ord", "task_number", "score"), ["ord", "task_number"], "left").select("ord", "task_number", F.coalesce("score", F.lit(0.0)).alias("score"))


def binarize(models: DataFrame, pool: DataFrame, skills: DataFrame, threshold: float = 0.5) -> DataFrame:
    """ord, pos (place of the task in the pool's order), solved."""
    cells = grid(models, pool, skills).join(placed(pool.select("task_number"), ["task_number"], "pos", start=0), "task_number")
    return cells.select("ord", "pos", (F.col("score") >= threshold).alias("solved"))


def example_vector(results: DataFrame) -> DataFrame:
    """Per model the correct flags in task order, then example order; a missing flag is false."""
    item = F.struct("task_ord", "example_id", F.coalesce("correct", F.lit(False)).alias("correct"))
    return results.groupBy("ord").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["correct"]).alias("vector"))


def difficulty_weights(bits: DataFrame) -> DataFrame:
    """Per position the share of the population that fails."""
    return bits.groupBy("pos").agg((F.count_if(~F.col("solved")) / F.count("*")).alias("weight"))


def archive_coverage(skills: DataFrame, threshold: float = 0.5, top: int = 5) -> DataFrame:
    """Over models with skills and all tasks seen: tasks that any model passes, and that the ``top`` models pass.

    The top models pass most tasks; ties go to the earlier place. A model passes a task with score >= threshold.
    """
    passed = skills.where(F.col("score") >= threshold)
    total = skills.agg(F.count_distinct("task_number").alias("total"))
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "ord"))
    best = skills.groupBy("ord").agg(F.count_if(F.col("score") >= threshold).alias("n")).withColumn("rank", rank).where(F.col("rank") <= top)
    every = passed.agg(F.count_distinct("task_number").alias("passed_all"))
    some = passed.join(best, "ord", "left_semi").agg(F.count_distinct("task_number").alias("passed_top"))
    one = total.join(every, F.lit(True)).join(some, F.lit(True))  # three single rows
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("total")), F.lit(0.0))
    return one.withColumns({"ratio_all": share("passed_all"), "ratio_top": share("passed_top")})


def validation_metrics(archive: DataFrame, top: int = 5) -> DataFrame:
    """The ``top`` models by fitness: rank, fitness, validation quality, and the best validation quality among them."""
    rank = F.row_number().over(Window.orderBy(F.desc("fitness"), "ord"))
    best = archive.withColumn("rank", rank).where(F.col("rank") <= top)
    return best.select("rank", "ord", "fitness", "validation_quality", F.max("validation_quality").over(Window.partitionBy()).alias("best_validation"))


def gibberish_prompts(outputs: DataFrame, draw: Column, n: int = 3) -> DataFrame:
    """Per model ``n`` outputs by random order, numbered in one prompt."""
    rank = F.row_number().over(Window.partitionBy("ord").orderBy(draw, "sample_id"))
    few = outputs.withColumn("rank", rank).where(F.col("rank") <= n)
    line = F.struct("rank", F.concat(F.lit("Output "), F.col("rank").cast("string"), F.lit(": "), F.col("raw_output")).alias("line"))
    prompt = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n\n")
    return few.groupBy("ord").agg(prompt.alias("prompt"))


def gibberish_verdict(response: Column) -> Column:
    return F.contains(response, F.lit("Answer: Yes"))


def gibberish_filter(solutions: DataFrame, is_seed: Column, enabled: bool = True) -> tuple[DataFrame, DataFrame]:
    """(solutions that stay, number of flagged ones that are no seeds). Seeds leave with the flagged ones."""
    count = solutions.agg(F.count_if(F.col("is_gibberish") & ~is_seed).alias("flagged"))
    return (solutions.where(~F.col("is_gibberish") & ~is_seed) if enabled else solutions), count


def generation_metrics(archive: DataFrame, skills: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per generation: best fitness, archive size, skill vector length of the fittest, gibberish count, tasks passed."""
    lead = F.max_by(F.struct("n_skills", "fitness"), F.struct("fitness", (-F.col("ord")).alias("o")))
    per = archive.groupBy("gen").agg(lead.alias("lead"), F.count("*").alias("archive_size"), F.count_if("is_gibberish").alias("gibberish"))
    passed = skills.groupBy("gen").agg(F.count_distinct(F.when(F.col("score") >= threshold, F.col("task_number"))).alias("passed"), F.count_distinct("task_number").alias("tasks"))
    return per.join(passed, "gen", "left").select("gen", F.col("lead.fitness").alias("best_fitness"), "archive_size", F.col("lead.n_skills").alias("skill_length"), "gibberish", "passed", "tasks")


def top_fitness_mean(archive: DataFrame) -> DataFrame:
    return archive.agg(F.bround(F.avg("fitness"), 2).alias("mean_fitness"))


def bin_ids(values: list[Column], lows: list[float], highs: list[float], sizes: list[int]) -> list[Column]:
    """Grid cell of each dimension: edges below the value, less one; all dimensions are cut at the first one's size."""

    def cell(v: Column, lo: float, hi: float, n: int) -> Column:
        edges = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.lit(lo) + i * F.lit((hi - lo) / n))
        below = F.aggregate(edges, F.lit(0), lambda k, e: k + F.when(e < v, 1).otherwise(0))
        return F.greatest(F.lit(0), F.least(below - 1, F.lit(sizes[0] - 1)))

    return [cell(*x) for x in zip(values, lows, highs, sizes, strict=True)]


def cell_elites(cells: DataFrame) -> DataFrame:
    """Per (x, y) the first row with the highest quality, and its validation quality."""
    best = F.max_by(F.struct("ord", "quality", "validation_quality"), F.struct("quality", (-F.col("ord")).alias("o")))
    return cells.groupBy("x", "y").agg(best.alias("e")).select("x", "y", "e.*")


def elite_table(archive: DataFrame, k: int) -> DataFrame:
    """Top ``k`` of every category with their validation quality in every category (3 places); absent: not elite.

    category, model_path, rank, of (other category), cell: the text of the quality, null where it has none.
    """
    rank = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("quality"), "ord"))
    top = archive.withColumn("rank", rank).where(F.col("rank") <= k)
    others = archive.select(F.col("category").alias("of")).distinct()
    values = archive.select(F.col("category").alias("of"), "model_path", F.bround("validation_quality", 3).alias("value"), F.lit(True).alias("there"))
    names = F.array_sort(F.collect_set("of"))
    wide = top.join(others.agg(names.alias("names")), F.lit(True)).withColumn("of", F.explode("names"))
    found = wide.join(values, ["of", "model_path"], "left")
    cell = F.when(F.col("there"), F.col("value").cast("string")).otherwise("not elite")
    return found.select("category", "rank", "model_path", "of", cell.alias("cell"))
