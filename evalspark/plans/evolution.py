"""Generation, lineage and incremental queries."""

from pyspark.sql import functions as F

from evalspark.operators import coverage, evolution as e, incremental as k
from evalspark.plans.registry import query

FIRST = "first AS (SELECT task_number, min(gen) AS first_gen FROM active_pool GROUP BY task_number)"


@query("j01_solved_share", "SELECT gen, sample_id, count(*) FILTER (correct) / count(*) AS share, count(*) AS models FROM samples WHERE ord % 4 < 2 GROUP BY gen, sample_id")
def share(v):
    return e.solved_share(v.samples, v.samples.where("ord % 4 < 2").select("gen", "model_name").distinct())


@query("j02_adaptation_counts", "SELECT kind, count(*) AS count, list_position(['seed_task', 'initial', 'adaptation_easier', 'adaptation_harder', 'adaptation_novel'], kind) AS place FROM (SELECT CASE WHEN parent_number IS NULL THEN 'seed_task' ELSE generation_type END AS kind FROM tasks) x GROUP BY kind")
def counts(v):
    return e.adaptation_counts(v.tasks.withColumn("generation_type", F.when(F.col("parent_number").isNotNull(), F.col("generation_type"))))


@query("j03_new_and_missing", f"WITH {FIRST}, g AS (SELECT DISTINCT gen FROM active_pool) SELECT g.gen, (SELECT count(*) FROM first WHERE first_gen = g.gen) AS new, (SELECT count(*) FROM first f WHERE f.first_gen <= g.gen AND f.task_number NOT IN (SELECT task_number FROM active_pool a WHERE a.gen = g.gen)) AS missing FROM g")
def new_missing(v):
    return e.new_and_missing(v.active_pool)


@query("j04_adaptation_types", f"WITH {FIRST}, g AS (SELECT DISTINCT gen FROM active_pool), k AS (SELECT unnest(['adaptation_easier', 'adaptation_harder', 'adaptation_novel']) AS kind) SELECT g.gen, k.kind, (SELECT count(*) FROM first f JOIN tasks t USING (task_number) WHERE f.first_gen = g.gen AND t.generation_type = k.kind) AS n FROM g CROSS JOIN k")
def types(v):
    return e.adaptation_types(v.active_pool, v.tasks)


@query("j05_pool_sizes", f"WITH {FIRST} SELECT gen, count(*) AS active, (SELECT count(*) FROM first WHERE first_gen <= a.gen) AS so_far FROM active_pool a GROUP BY gen")
def sizes(v):
    return e.pool_sizes(v.active_pool)


@query("j06_metric_evolution", "WITH sel AS (SELECT gen, n, model_name FROM (SELECT DISTINCT gen, ord, model_name FROM samples) s, (SELECT unnest([1, 2, 3, 4]) AS n) k WHERE s.ord % 4 < k.n), per AS (SELECT e.gen, e.n, s.benchmark, s.filter, s.sample_id, count(*) FILTER (s.correct) AS solvers FROM sel e JOIN samples s ON s.model_name = e.model_name GROUP BY ALL) SELECT gen, n, benchmark, filter, count(*) FILTER (solvers > 0) / count(*) AS coverage_accuracy, count(*) FILTER (solvers > n / 2) / count(*) AS majority_accuracy, 100.0 * (count(*) FILTER (solvers = 1) / count(*)) AS unique_rate FROM per GROUP BY ALL")
def metrics(v):
    names = v.samples.select("gen", "ord", "model_name").distinct().withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(4)))).where("ord % 4 < n")
    return coverage.sweep(v.samples.drop("gen"), names.select("gen", "n", "model_name"), ["gen", "n"])[0].select("gen", "n", "benchmark", "filter", "coverage_accuracy", "majority_accuracy", "unique_rate")


SOLVED = "res AS (SELECT benchmark, gen, model_name, count(*) FILTER (correct) AS value FROM samples GROUP BY ALL)"


def solved(v):
    return v.samples.groupBy("benchmark", "gen", "model_name").agg(F.count_if("correct").alias("value"))


@query("j07_benchmark_averages", f"WITH {SOLVED}, r AS (SELECT gen, benchmark, avg(value) AS value FROM res GROUP BY ALL) SELECT gen, benchmark, round(avg(value), 9) AS mean, count(*) AS n FROM r GROUP BY GROUPING SETS ((gen, benchmark), (gen))")
def averages(v):
    return e.averages(solved(v), ["gen"]).withColumn("mean", F.round("mean", 9))


@query("j07_baseline_averages", f"WITH {SOLVED}, r AS (SELECT gen, benchmark, avg(value) AS value FROM res GROUP BY ALL) SELECT gen, round(sum(value) / 4, 6) AS mean, round(sqrt(greatest(sum(value * value) / 4 - (sum(value) / 4) * (sum(value) / 4), 0)), 6) AS deviation, count(*) AS n FROM r GROUP BY gen")
def baseline(v):
    return e.averages(solved(v), ["gen"], 4).withColumns({"mean": F.round("mean", 6), "deviation": F.round("deviation", 6)})


@query("j08_task_ancestry", "WITH RECURSIVE chain AS (SELECT task_number, 0 AS step, task_number AS ancestor, parent_number AS parent, original_pass_rate AS rate FROM tasks UNION ALL SELECT c.task_number, c.step + 1, t.task_number, t.parent_number, t.original_pass_rate FROM chain c JOIN tasks t ON c.parent = t.task_number) SELECT task_number, step, ancestor, rate FROM chain")
def ancestry(v):
    return e.ancestry(v.tasks)


@query("j09_reported_rates", "SELECT parent_number, string_agg(CAST(CAST(original_pass_rate * 16 AS BIGINT) AS STRING), ',' ORDER BY task_number) AS rates FROM tasks WHERE parent_number IS NOT NULL GROUP BY parent_number")
def rates(v):
    return e.reported_rates(v.tasks).select("parent_number", F.array_join(F.transform("rates", lambda x: (x * 16).cast("bigint").cast("string")), ",").alias("rates"))


@query("j10_model_lineage", "WITH RECURSIVE up AS (SELECT DISTINCT child, parent AS ancestor FROM model_edges UNION SELECT u.child, e.parent FROM up u JOIN model_edges e ON e.child = u.ancestor) SELECT child, ancestor FROM up")
def lineage(v):
    return e.lineage(v.model_edges, v.model_edges.select("child").distinct())


@query("j11_task_tree_nodes", f"WITH {FIRST} SELECT task_number, first_gen AS gen FROM first UNION ALL SELECT DISTINCT t.parent_number, -1 FROM tasks t JOIN first f ON f.task_number = t.task_number WHERE t.parent_number IS NOT NULL AND t.parent_number NOT IN (SELECT task_number FROM first)")
def tree_nodes(v):
    return e.task_tree(v.active_pool, v.tasks)[0]


@query("j11_task_tree_edges", f"WITH {FIRST} SELECT t.parent_number AS parent, t.task_number AS child FROM tasks t JOIN first f ON f.task_number = t.task_number LEFT JOIN first p ON p.task_number = t.parent_number WHERE t.parent_number IS NOT NULL AND (p.first_gen IS NULL OR p.first_gen < (SELECT max(first_gen) FROM first))")
def task_edges(v):
    return e.task_tree(v.active_pool, v.tasks)[1].select("parent", "child")


PARENTS = "parents AS (SELECT child, CASE WHEN parent LIKE 'gen_0%' THEN concat('Seed-', substring(parent, 11)) ELSE parent END AS parent FROM model_edges)"


def parents(v):
    """Models of generation 0 are not themselves children; half of the edges to them name a seed instead."""
    return v.model_edges.withColumn("parent", F.when(F.startswith("parent", F.lit("gen_0")), F.concat(F.lit("Seed-"), F.substring("parent", 11, 9))).otherwise(F.col("parent")))


@query("j11_model_tree_nodes", f"WITH {PARENTS}, n AS (SELECT child AS model FROM parents UNION SELECT parent FROM parents) SELECT model, CASE WHEN model LIKE 'gen_%' THEN CAST(split_part(model, '_', 2) AS BIGINT) ELSE -1 END AS gen, NOT model LIKE 'gen_%' AS is_seed FROM n")
def model_nodes(v):
    return e.model_tree(parents(v))[0]


@query("j11_model_tree_edges", "SELECT child, parent FROM model_edges WHERE parent IN (SELECT child FROM model_edges)")
def tree_edges(v):
    """Parents of generation 0 are no seeds by name and have no parents: edges to them are left out."""
    return e.model_tree(v.model_edges)[1].select("child", "parent")


@query("j11_seeded_tree_edges", f"WITH {PARENTS} SELECT child, parent FROM parents WHERE parent IN (SELECT child FROM parents) OR parent LIKE 'Seed%'")
def seeded_edges(v):
    return e.model_tree(parents(v))[1].select("child", "parent")


@query("j12_change_points", "WITH s AS (SELECT gen, string_agg(CAST(task_number AS STRING), ',' ORDER BY task_number) AS t FROM active_pool GROUP BY gen), l AS (SELECT gen, t, lag(t) OVER (ORDER BY gen) AS b FROM s) SELECT gen, row_number() OVER (ORDER BY gen) AS change FROM l WHERE b IS NULL OR b <> t")
def changes(v):
    return e.change_points(v.active_pool)[0]


@query("j12_change_step", "WITH s AS (SELECT gen, string_agg(CAST(task_number AS STRING), ',' ORDER BY task_number) AS t FROM active_pool GROUP BY gen), l AS (SELECT gen, t, lag(t) OVER (ORDER BY gen) AS b FROM s), c AS (SELECT gen, row_number() OVER (ORDER BY gen) AS change FROM l WHERE b IS NULL OR b <> t) SELECT max(gen) FILTER (change = 3) - max(gen) FILTER (change = 2) AS step FROM c")
def step(v):
    return e.change_points(v.active_pool)[1]


@query("j13_group_scores", "SELECT model_name, filter AS \"group\", count(*) FILTER (correct) AS value FROM samples WHERE benchmark = 'A' GROUP BY model_name, filter")
def groups(v):
    rows = v.samples.where("benchmark = 'A'").groupBy("model_name", F.concat(F.lit("mmlu_"), "filter").alias("group")).agg(F.count_if("correct").alias("value"))
    both = rows.withColumn("file", F.lit("samples_mmlu.jsonl")).unionByName(rows.withColumn("file", F.lit("samples_mmlu_llm_as_a_judge.jsonl")))
    return e.group_scores(both, "mmlu", judge=False)


@query("j14_scaling_table", f"WITH {SOLVED}, r AS (SELECT benchmark, 8 AS n, gen, avg(value) AS value FROM res GROUP BY benchmark, gen) SELECT benchmark, n, gen, round(value, 9) AS value FROM r UNION ALL SELECT 'average', n, gen, round(avg(value), 9) FROM r GROUP BY n, gen")
def scaling(v):
    rows = solved(v).groupBy("benchmark", F.concat(F.lit("coverage_gen_"), F.col("gen").cast("string")).alias("method")).agg(F.avg("value").alias("value")).withColumn("n", F.lit(8))
    return e.scaling_table(rows).withColumn("value", F.round("value", 9))


@query("j15_wide_shares", "SELECT benchmark, filter, count(*) FILTER (model_name = 'gen_0_ind_0') / count(*) AS gen_0_ind_0, count(*) FILTER (model_name = 'gen_1_ind_1') / count(*) AS gen_1_ind_1 FROM samples WHERE correct GROUP BY ALL")
def wide(v):
    return e.wide_shares(v.samples.where("correct"), ["benchmark", "filter"], ["gen_0_ind_0", "gen_1_ind_1"])


@query("j15_unpivoted", "SELECT benchmark, filter, 'rows' AS metric, count(*) AS value FROM samples GROUP BY ALL UNION ALL SELECT benchmark, filter, 'solved', count(*) FILTER (correct) FROM samples GROUP BY ALL")
def unpivoted(v):
    rows = v.samples.groupBy("benchmark", "filter").agg(F.count("*").alias("rows"), F.count_if("correct").alias("solved"))
    return e.unpivoted(rows, ["benchmark", "filter"], ["rows", "solved"])


@query("k01_latest_generation", "SELECT max(gen) AS gen FROM archive")
def latest(v):
    return k.latest_generation(v.archive)


KEEP = "keep AS (SELECT DISTINCT model_path FROM archive WHERE gen = 7 OR (gen % 3 = 0 AND gen > 0))"


@query("k02_retention_keep_set", f"WITH {KEEP} SELECT model_path FROM keep")
def keep(v):
    return k.keep_set(v.archive, 7, 3)


@query("k03_retention_candidates", f"WITH {KEEP} SELECT model_path FROM archive WHERE gen < 6 AND gen % 3 <> 0 AND model_path NOT IN (SELECT model_path FROM keep)")
def candidates(v):
    return k.retention_candidates(v.archive.select("model_path"), k.keep_set(v.archive, 7, 3), 6, 3).select("model_path")


@query("k04_not_evaluated", "SELECT model_path FROM archive WHERE model_path NOT IN (SELECT model_name FROM samples WHERE benchmark = 'A' AND correct)")
def not_evaluated(v):
    done = v.samples.where("benchmark = 'A' AND correct").select(F.col("model_name").alias("model_path"))
    return k.not_evaluated(v.archive, done).select("model_path")


@query("k05_open_benchmarks", "WITH stored AS (SELECT DISTINCT benchmark, method FROM samples, (SELECT unnest(['judge', 'logprob']) AS method) m WHERE NOT (benchmark = 'R' AND method = 'judge')) SELECT s.benchmark FROM (SELECT DISTINCT benchmark FROM samples) s LEFT JOIN stored t ON t.benchmark = s.benchmark GROUP BY s.benchmark HAVING count(t.method) < 2")
def open_benchmarks(v):
    stored = v.samples.select("benchmark").distinct().withColumn("method", F.explode(F.array(F.lit("judge"), F.lit("logprob")))).where("NOT (benchmark = 'R' AND method = 'judge')")
    return k.open_benchmarks(v.samples.select("benchmark").distinct(), stored, ["judge", "logprob"])


@query("k06_missing_models", "SELECT DISTINCT model_name FROM samples WHERE gen >= 6")
def missing(v):
    return k.missing(v.samples, v.samples.where("gen < 6"))


@query("k07_already_scored", "SELECT model_name, bool_and(score >= 0.04) AS done FROM samples GROUP BY model_name")
def scored(v):
    scores = F.when(F.col("score") >= 0.04, F.create_map(F.lit("rm"), F.col("score").cast("double"))).otherwise(F.create_map().cast("map<string,double>"))
    return k.already_scored(v.samples.withColumn("scores", scores), "rm")


@query("a14_upsert_results", "SELECT benchmark, filter, model_name, CASE WHEN gen >= 4 THEN 1 ELSE 0 END AS value FROM samples GROUP BY benchmark, filter, model_name, gen")
def upsert(v):
    old = v.samples.select("benchmark", "filter", "model_name").distinct().withColumn("value", F.lit(0))
    new = v.samples.where("gen >= 4").select("benchmark", "filter", "model_name").distinct().withColumn("value", F.lit(1))
    return k.upserted(old, new, ["benchmark", "filter", "model_name"])
