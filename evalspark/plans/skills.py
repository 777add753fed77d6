"""Skill vector and archive queries."""

from pyspark.sql import functions as F

from evalspark.functions.hashing import draw, draw_sql
from evalspark.functions.text import is_seed_model
from evalspark.operators import skills as s
from evalspark.plans.registry import query

POOL = "(SELECT task_number FROM active_pool WHERE gen = 2)"


def population(v):
    return v.archive.select("ord", "model_path")


@query("d01_skill_vectors", "SELECT ord, model_path, count(*) AS n, CAST(sum(CAST(round(score * 50) AS BIGINT)) AS BIGINT) AS points, string_agg(concat(CAST(task_number AS STRING), ':', CAST(CAST(round(score * 50) AS BIGINT) AS STRING)), ' ' ORDER BY task_number) AS vector FROM skills GROUP BY ord, model_path")
def vectors(v):
    one = lambda e: F.concat(e["key"].cast("string"), F.lit(":"), F.round(e["value"] * 50).cast("bigint").cast("string"))
    whole = s.assemble(v.skills).withColumn("entries", F.map_entries("skills"))
    points = F.aggregate("entries", F.lit(0).cast("bigint"), lambda a, e: a + F.round(e["value"] * 50).cast("bigint"))
    return whole.select("ord", "model_path", "n", points.alias("points"), F.array_join(F.transform("entries", one), " ").alias("vector"))


@query("d02_fitness", "SELECT ord, model_path, round(avg(score), 9) AS fitness FROM skills GROUP BY ALL")
def fitness(v):
    return s.fitness(population(v), v.skills).withColumn("fitness", F.round("fitness", 9))


@query("d03_combined_fitness", "WITH t AS (SELECT ord, sum(CAST(score AS DOUBLE)) AS total, count(*) AS tasks FROM skills JOIN tasks USING (task_number) WHERE generation_type = 'initial' GROUP BY ord), q AS (SELECT ord, avg(score) AS quality FROM skills JOIN tasks USING (task_number) WHERE generation_type <> 'initial' AND gen < 7 GROUP BY ord) SELECT ord, round((coalesce(total, 0) + coalesce(quality, 0)) / (coalesce(tasks, 0) + CASE WHEN quality IS NOT NULL THEN 1 ELSE 0 END), 9) AS fitness FROM t FULL JOIN q USING (ord)")
def combined(v):
    typed = v.skills.join(v.tasks.select("task_number", "generation_type"), "task_number")
    tasks = typed.where("generation_type = 'initial'").select("ord", F.col("score").alias("quality"))
    quality = typed.where("generation_type <> 'initial' AND gen < 7").groupBy("ord").agg(F.avg("score").alias("quality"))
    return s.combined_fitness(tasks, quality).withColumn("fitness", F.round("fitness", 9))


BITS = f"pool AS (SELECT task_number, row_number() OVER (ORDER BY task_number) - 1 AS pos FROM {POOL} p), bits AS (SELECT m.ord, p.pos, coalesce(k.score, 0) >= 0.5 AS solved FROM (SELECT DISTINCT ord FROM skills) m CROSS JOIN pool p LEFT JOIN skills k ON k.ord = m.ord AND k.task_number = p.task_number)"


def bits_of(v):
    return s.binarize(population(v), v.active_pool.where("gen = 2"), v.skills)


@query("d04_binarized", f"WITH {BITS} SELECT ord, pos, solved FROM bits")
def binarized(v):
    return bits_of(v)


@query("d05_example_vectors", "SELECT ord, string_agg(CASE WHEN score >= 0.5 THEN '1' ELSE '0' END, '' ORDER BY task_number % 4, task_number) AS vector FROM skills GROUP BY ord")
def examples(v):
    rows = v.skills.select("ord", (F.col("task_number") % 4).alias("task_ord"), F.col("task_number").alias("example_id"), (F.col("score") >= 0.5).alias("correct"))
    return s.example_vector(rows).select("ord", F.array_join(F.transform("vector", lambda x: F.when(x, "1").otherwise("0")), "").alias("vector"))


@query("d06_difficulty_weights", f"WITH {BITS} SELECT pos, count(*) FILTER (NOT solved) / count(*) AS weight FROM bits GROUP BY pos")
def weights(v):
    return s.difficulty_weights(bits_of(v))


@query("d07_archive_coverage", "WITH n AS (SELECT ord, count(*) FILTER (score >= 0.5) AS n FROM skills GROUP BY ord), top AS (SELECT ord FROM (SELECT ord, row_number() OVER (ORDER BY n DESC, ord) AS r FROM n) x WHERE r <= 5), t AS (SELECT count(DISTINCT task_number) AS total, count(DISTINCT task_number) FILTER (score >= 0.5) AS passed_all, count(DISTINCT task_number) FILTER (score >= 0.5 AND ord IN (SELECT ord FROM top)) AS passed_top FROM skills) SELECT total, passed_all, passed_top, passed_all / total AS ratio_all, passed_top / total AS ratio_top FROM t")
def archive_coverage(v):
    return s.archive_coverage(v.skills)


@query("d08_validation_metrics", "WITH r AS (SELECT ord, round(fitness, 9) AS fitness, validation_quality, row_number() OVER (ORDER BY round(fitness, 9) DESC, ord) AS rank FROM archive) SELECT rank, ord, validation_quality, max(validation_quality) OVER () AS best_validation FROM r WHERE rank <= 5")
def validation(v):
    return s.validation_metrics(v.archive.withColumn("fitness", F.round("fitness", 9))).drop("fitness")


@query("d09_gibberish_prompts", f"WITH r AS (SELECT conv_id % 8 AS ord, conv_id * 100 + turn AS sample_id, text AS raw_output, row_number() OVER (PARTITION BY conv_id % 8 ORDER BY {draw_sql('conv_id * 100 + turn')}, conv_id * 100 + turn) AS rank FROM assistant_texts) SELECT ord, string_agg(concat('Output ', CAST(rank AS STRING), ': ', raw_output), chr(10) || chr(10) ORDER BY rank) AS prompt FROM r WHERE rank <= 3 GROUP BY ord")
def gibberish(v):
    rows = v.assistant_texts.select((F.col("conv_id") % 8).alias("ord"), (F.col("conv_id") * 100 + F.col("turn")).alias("sample_id"), F.col("text").alias("raw_output"))
    return s.gibberish_prompts(rows, draw(F.col("sample_id")))


SEEDED = "seeded AS (SELECT ord, CASE WHEN gen = 0 THEN concat('Seed-', CAST(ord AS STRING)) ELSE model_path END AS model_path, gen = 0 AS is_seed, is_gibberish FROM archive)"


def seeded(v):
    """The archive, with the models of generation 0 as seeds, one of which is flagged."""
    return v.archive.withColumn("model_path", F.when(F.col("gen") == 0, F.concat(F.lit("Seed-"), F.col("ord").cast("string"))).otherwise(F.col("model_path")))


@query("d10_gibberish_filter", f"WITH {SEEDED} SELECT ord, model_path FROM seeded WHERE NOT is_gibberish AND NOT is_seed")
def gibberish_filter(v):
    return s.gibberish_filter(seeded(v), is_seed_model(F.col("model_path")))[0].select("ord", "model_path")


@query("d10_gibberish_count", f"WITH {SEEDED} SELECT count(*) FILTER (is_gibberish AND NOT is_seed) AS flagged FROM seeded")
def gibberish_count(v):
    return s.gibberish_filter(seeded(v), is_seed_model(F.col("model_path")))[1]


@query("d11_generation_metrics", "WITH a AS (SELECT gen, max(round(fitness, 9)) AS best_fitness, count(*) AS archive_size, arg_max(n_skills, struct_pack(f := round(fitness, 9), o := -ord)) AS skill_length, count(*) FILTER (is_gibberish) AS gibberish FROM archive GROUP BY gen), p AS (SELECT gen, count(DISTINCT task_number) FILTER (score >= 0.5) AS passed, count(DISTINCT task_number) AS tasks FROM skills GROUP BY gen) SELECT a.gen, best_fitness, archive_size, skill_length, gibberish, passed, tasks FROM a JOIN p USING (gen)")
def generation_metrics(v):
    return s.generation_metrics(v.archive.withColumn("fitness", F.round("fitness", 9)), v.skills)


@query("d12_top_fitness_mean", "SELECT round(avg(fitness), 2) AS mean_fitness FROM archive")
def top_mean(v):
    return s.top_fitness_mean(v.archive)


@query("d13_grid_bins", "SELECT p_partkey AS ord, greatest(0, least(CAST(ceil((p_retailprice - 900) / 200.0) AS BIGINT) - 1, 4)) AS x, greatest(0, least(p_size // 10 + CASE WHEN p_size % 10 > 0 THEN 1 ELSE 0 END - 1, 4)) AS y FROM part WHERE p_retailprice >= 900")
def bins(v):
    rows = v.part.where("p_retailprice >= 900")
    x, y = s.bin_ids([F.col("p_retailprice"), F.col("p_size").cast("double")], [900.0, 0.0], [1900.0, 50.0], [5, 5])
    return rows.select(F.col("p_partkey").alias("ord"), x.alias("x"), y.alias("y"))


CELLS = "cells AS (SELECT p_partkey AS ord, p_size % 7 AS x, p_partkey % 5 AS y, p_size % 11 AS quality, p_partkey % 13 AS validation_quality FROM part)"


@query("d14_cell_elites", f"WITH {CELLS} SELECT x, y, arg_max(ord, struct_pack(q := quality, o := -ord)) AS ord, max(quality) AS quality, arg_max(validation_quality, struct_pack(q := quality, o := -ord)) AS validation_quality FROM cells GROUP BY x, y")
def elites(v):
    return s.cell_elites(v.part.selectExpr("p_partkey AS ord", "p_size % 7 AS x", "p_partkey % 5 AS y", "p_size % 11 AS quality", "p_partkey % 13 AS validation_quality"))


@query("d15_elite_table", "WITH a AS (SELECT p_brand AS category, concat('m', CAST(p_partkey % 40 AS STRING)) AS model_path, min(p_partkey) AS ord, max(p_size) AS quality, max(p_size) * 10 AS validation_quality FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY quality DESC, ord) AS rank FROM a), cats AS (SELECT DISTINCT category AS other FROM a) SELECT r.category, r.rank, r.model_path, c.other AS of, coalesce(CAST(x.validation_quality AS STRING), 'not elite') AS cell FROM r CROSS JOIN cats c LEFT JOIN a x ON x.category = c.other AND x.model_path = r.model_path WHERE r.rank <= 3")
def elite_table(v):
    rows = v.part.groupBy(F.col("p_brand").alias("category"), F.concat(F.lit("m"), (F.col("p_partkey") % 40).cast("string")).alias("model_path")).agg(F.min("p_partkey").alias("ord"), F.max("p_size").alias("quality"), (F.max("p_size") * 10).alias("validation_quality"))
    return s.elite_table(rows, 3)
