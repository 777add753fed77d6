"""Coverage queries."""

from pyspark.sql import functions as F

from evalspark.operators import coverage as c
from evalspark.plans.registry import query
from evalspark.plans.sources import result_files
from evalspark.sources import harness

PER = "per AS (SELECT benchmark, filter, sample_id, count(*) FILTER (correct) AS solvers, min(model_name) FILTER (correct) AS a_solver FROM samples GROUP BY ALL)"
SETS = """sets AS (
  SELECT 'fitness' AS method, n, model_name FROM (SELECT DISTINCT ord, model_name FROM samples) s, (SELECT unnest([2, 4, 8]) AS n) k WHERE s.ord < k.n
  UNION ALL SELECT 'every_second', n, model_name FROM (SELECT DISTINCT ord, model_name FROM samples) s, (SELECT unnest([2, 4, 8]) AS n) k WHERE s.ord % 2 = 0 AND s.ord < 2 * k.n)"""


def selections(v):
    names = v.samples.select("ord", "model_name").distinct()
    sets = names.withColumn("n", F.explode(F.array(F.lit(2), F.lit(4), F.lit(8))))
    a = sets.where("ord < n").select(F.lit("fitness").alias("method"), "n", "model_name")
    return a.unionByName(sets.where("ord % 2 = 0 AND ord < 2 * n").select(F.lit("every_second").alias("method"), "n", "model_name"))


def covered(v):
    return c.coverage(v.samples_by_sample, models=c.model_counts(v.samples))


@query("c01_score_matrix", "WITH chosen AS (SELECT DISTINCT model_name FROM samples WHERE ord < 4), ids AS (SELECT DISTINCT benchmark, filter, sample_id FROM samples) SELECT i.benchmark, i.filter, i.sample_id, c.model_name, coalesce(s.correct, false) AS correct FROM ids i CROSS JOIN chosen c LEFT JOIN samples s ON s.benchmark = i.benchmark AND s.filter = i.filter AND s.sample_id = i.sample_id AND s.model_name = c.model_name")
def score_matrix(v):
    return c.score_matrix(v.samples_by_sample, v.samples.where("ord < 4"))


@query("c02_num_unique_samples", "SELECT benchmark, filter, count(DISTINCT sample_id) AS num_samples FROM samples GROUP BY ALL")
def unique_samples(v):
    return v.samples.groupBy(*c.KEYS).agg(F.count_distinct("sample_id").alias("num_samples"))


@query("c03_coverage_accuracy", f"WITH {PER} SELECT benchmark, filter, count(*) FILTER (solvers > 0) AS covered, count(*) FILTER (solvers > 0) / count(*) AS coverage_accuracy FROM per GROUP BY ALL")
def coverage_accuracy(v):
    return covered(v).select(*c.KEYS, "covered", "coverage_accuracy")


@query("c04_majority_vote", f"WITH {PER}, m AS (SELECT benchmark, filter, count(DISTINCT model_name) AS models FROM samples GROUP BY ALL) SELECT benchmark, filter, count(*) FILTER (solvers > models / 2) AS majority, count(*) FILTER (solvers > models / 2) / count(*) AS majority_accuracy FROM per JOIN m USING (benchmark, filter) GROUP BY ALL")
def majority(v):
    return covered(v).select(*c.KEYS, "majority", "majority_accuracy")


@query("c05_coverage_contributions", "SELECT benchmark, filter, model_name, count(*) AS contribution FROM samples WHERE correct GROUP BY ALL")
def contributions(v):
    return c.contributions(v.samples_by_sample).select(*c.KEYS, "model_name", "contribution")


@query("c06_unique_contributions", f"WITH {PER} SELECT benchmark, filter, a_solver AS model_name, count(*) AS unique_contribution FROM per WHERE solvers = 1 GROUP BY ALL")
def unique_contributions(v):
    return c.contributions(v.samples_by_sample).where("unique_contribution > 0").select(*c.KEYS, "model_name", "unique_contribution")


@query("c07_contribution_shares", f"WITH {PER}, t AS (SELECT benchmark, filter, count(*) AS num_samples, count(*) FILTER (solvers > 0) AS covered FROM per GROUP BY ALL) SELECT s.benchmark, s.filter, s.model_name, count(*) / any_value(covered) AS contribution_share, 100.0 * count(*) FILTER (solvers = 1) / any_value(num_samples) AS unique_percent FROM samples s JOIN per p ON s.benchmark = p.benchmark AND s.filter = p.filter AND s.sample_id = p.sample_id JOIN t ON t.benchmark = s.benchmark AND t.filter = s.filter WHERE s.correct GROUP BY ALL")
def shares(v):
    return c.contributions(v.samples_by_sample).dropna(subset=list(c.KEYS)).select(*c.KEYS, "model_name", "contribution_share", "unique_percent")


@query("c08_individual_accuracies", "SELECT benchmark, model_name, count(*) FILTER (correct) / count(*) AS accuracy FROM samples WHERE filter = 'F' AND NOT (benchmark = 'N' AND ord % 3 = 0) GROUP BY ALL")
def individual(v):
    """From result files, some of whose values are null."""
    files = harness.read_results(v.spark, result_files(v, F.when(~((F.col("benchmark") == "N") & (F.col("ord") % 3 == 0)), 1.0)))
    return c.individual_accuracies(files, {b: "exact_match,F" for b in "ANR"})


@query("c09_benchmark_sweep", f"WITH {PER}, m AS (SELECT benchmark, filter, count(DISTINCT model_name) AS models FROM samples GROUP BY ALL) SELECT benchmark, filter, count(*) AS num_samples, count(*) FILTER (solvers > 0) AS covered, count(*) FILTER (solvers > models / 2) AS majority, count(*) FILTER (solvers = 1) AS unique_solved FROM per JOIN m USING (benchmark, filter) GROUP BY ALL")
def sweep(v):
    return covered(v).select(*c.KEYS, "num_samples", "covered", "majority", "unique_solved")


@query("c10_generation_sweep", "WITH sel AS (SELECT gen, n, ord, model_name FROM (SELECT DISTINCT gen, ord, model_name FROM samples) s, (SELECT unnest([1, 2, 3, 4]) AS n) k WHERE s.ord % 4 < k.n), per AS (SELECT e.gen, e.n, s.benchmark, s.filter, s.sample_id, count(*) FILTER (s.correct) AS solvers FROM sel e JOIN samples s ON s.model_name = e.model_name GROUP BY ALL) SELECT gen, n, benchmark, filter, count(*) AS num_samples, count(*) FILTER (solvers > 0) AS covered, count(*) FILTER (solvers > n / 2) AS majority FROM per GROUP BY ALL")
def generation_sweep(v):
    names = v.samples.select("gen", "ord", "model_name").distinct().withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(4)))).where("ord % 4 < n")
    return c.sweep(v.samples.drop("gen"), names.select("gen", "n", "model_name"), ["gen", "n"])[0].select("gen", "n", *c.KEYS, "num_samples", "covered", "majority")


@query("c11_method_sweep", f"WITH {SETS}, per AS (SELECT method, n, benchmark, filter, sample_id, count(*) FILTER (correct) AS solvers FROM sets JOIN samples USING (model_name) GROUP BY ALL) SELECT method, n, benchmark, filter, count(*) FILTER (solvers > 0) AS covered, count(*) FILTER (solvers = 1) AS unique_solved, count(*) AS num_samples FROM per GROUP BY ALL")
def method_sweep(v):
    return c.sweep(v.samples, selections(v), ["method", "n"])[0].select("method", "n", *c.KEYS, "covered", "unique_solved", "num_samples")


@query("c12_baseline_prefixes", "WITH sel AS (SELECT n, model_name FROM (SELECT DISTINCT ord, model_name FROM samples) s, (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS n) k WHERE s.ord < k.n), per AS (SELECT n, benchmark, filter, sample_id, bool_or(correct) AS hit FROM sel JOIN samples USING (model_name) GROUP BY ALL) SELECT n, benchmark, filter, count(*) FILTER (hit) AS covered FROM per GROUP BY ALL")
def baseline(v):
    ranked = v.samples.select("model_name", (F.col("ord") + 1).cast("int").alias("rank")).distinct()
    return c.sweep(v.samples, c.prefixes(ranked), ["n"])[0].select("n", *c.KEYS, "covered")


EXPERTS = [f"expert_{i}" for i in range(3)]


@query("c12_baselines", "WITH named AS (SELECT *, CASE WHEN ord < 3 THEN concat('expert_', CAST(ord AS STRING)) WHEN ord = 3 THEN 'Some-70B-of-2025b' ELSE concat('control/seed_', CAST(ord AS STRING)) END AS name FROM samples), names AS (SELECT DISTINCT name FROM named), sel AS (SELECT 'experts' AS baseline, 3 AS n, name FROM names WHERE name LIKE 'expert%' UNION ALL SELECT 'big_70B', 1, name FROM names WHERE name LIKE 'Some%' UNION ALL SELECT 'control', n, name FROM (SELECT name, row_number() OVER (ORDER BY name) AS r FROM names WHERE name LIKE 'control%') x, (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS n) k WHERE r <= n), per AS (SELECT baseline, n, benchmark, filter, sample_id, count(*) FILTER (correct) AS solvers FROM sel JOIN named USING (name) GROUP BY ALL) SELECT baseline, n, benchmark, filter, count(*) FILTER (solvers > 0) AS covered, count(*) FILTER (solvers > n / 2) AS majority, count(*) AS num_samples FROM per GROUP BY ALL")
def baselines(v):
    """A set of three experts, a big model and growing sets of one model's seeds; a set with an absent model is no baseline."""
    name = F.when(F.col("ord") < 3, F.concat(F.lit("expert_"), F.col("ord").cast("string"))).when(F.col("ord") == 3, "Some-70B-of-2025b").otherwise(F.concat(F.lit("control/seed_"), F.col("ord").cast("string")))
    rows = v.samples.withColumn("model_name", name)
    sets = c.baselines(rows, EXPERTS, "Some-70B-of-2025b", "control/").unionByName(c.baselines(rows, [*EXPERTS, "absent"], "absent-8B", "absent"))
    return c.sweep(rows, sets, ["baseline", "n"])[0].select("baseline", "n", *c.KEYS, "covered", "majority", "num_samples")


@query("c13_unique_rate", f"WITH {PER} SELECT benchmark, filter, 100.0 * (count(*) FILTER (solvers = 1) / count(*)) AS unique_rate FROM per GROUP BY ALL")
def unique_rate(v):
    return covered(v).select(*c.KEYS, "unique_rate")


@query("c14_missing_models", "WITH gone AS (SELECT DISTINCT model_name FROM samples WHERE ord >= 30) SELECT DISTINCT model_name FROM gone")
def missing(v):
    sel = v.samples.select(F.lit("all").alias("method"), "model_name").distinct()
    return c.missing_models(sel, v.samples.where("ord < 30"), ["method"]).select("model_name")
