"""Task-pool queries."""

from pyspark.sql import functions as F

from evalspark.functions.hashing import M, draw, draw_sql, uniform
from evalspark.operators import pool as p
from evalspark.operators.vectors import with_earlier
from evalspark.plans.registry import query

RATED = """pool AS (SELECT task_number FROM active_pool WHERE gen = 2),
  rated AS (SELECT p.task_number, t.task_id, count(*) FILTER (k.score >= 0.9) AS passed, count(k.score) AS evaluated,
    CASE WHEN count(k.score) = 0 THEN -1.0 ELSE count(*) FILTER (k.score >= 0.9) / count(k.score) END AS rate
    FROM pool p JOIN tasks t USING (task_number) LEFT JOIN skills k ON k.task_number = p.task_number
    GROUP BY p.task_number, t.task_id),
  classed AS (SELECT *, CASE WHEN rate < 0 THEN 'unevaluated' WHEN rate = 0 THEN 'impossible' WHEN rate < 0.3 THEN 'hard' WHEN rate > 0.7 THEN 'easy' ELSE 'medium' END AS difficulty FROM rated)"""


def rated(v):
    pool = v.active_pool.where("gen = 2").select("task_number").join(v.tasks.select("task_number", "task_id"), "task_number")
    rows = p.pass_rates(pool, v.skills, 0.9)
    return rows.withColumn("difficulty", p.difficulty(F.col("rate")))


def replaced_parents(v):
    parents = v.tasks.where("parent_number IS NOT NULL").select(F.col("parent_number").alias("task_number"))
    return rated(v).join(parents, "task_number", "left_semi").select("task_number", "rate")


@query("g01_pass_rates", f"WITH {RATED} SELECT task_number, passed, evaluated, rate FROM rated")
def pass_rates(v):
    return rated(v).select("task_number", "passed", "evaluated", "rate")


@query("g02_difficulty", f"WITH {RATED} SELECT difficulty, count(*) AS n FROM classed GROUP BY difficulty")
def difficulty(v):
    return rated(v).groupBy("difficulty").agg(F.count("*").alias("n"))


@query("g03_class_order", f"WITH {RATED} SELECT task_number, difficulty, row_number() OVER (PARTITION BY difficulty ORDER BY CASE WHEN difficulty = 'easy' THEN -rate WHEN difficulty IN ('hard', 'medium') THEN rate ELSE 0 END, task_id) AS place FROM classed")
def class_order(v):
    return p.class_order(rated(v)).select("task_number", "difficulty", "place")


@query("g04_adaptation", f"WITH {RATED}, u AS (SELECT task_number, difficulty, {draw_sql('task_number', 1)} / {float(M)} AS u FROM classed) SELECT task_number, CASE WHEN difficulty IN ('impossible', 'hard') THEN 'easier' WHEN difficulty = 'easy' AND u < 0.5 THEN 'novel' WHEN difficulty = 'easy' THEN 'harder' WHEN difficulty = 'medium' AND u < 0.5 THEN 'novel_from_tasks' WHEN difficulty = 'medium' THEN 'novel_from_capabilities' END AS adaptation FROM u")
def adaptation(v):
    return rated(v).select("task_number", p.adaptation(F.col("difficulty"), uniform(F.col("task_number"), 1)).alias("adaptation"))


@query("g05_ordered_tasks", "SELECT task_number, row_number() OVER (ORDER BY task_number) AS place FROM active_pool WHERE gen = 1")
def ordered(v):
    return p.ordered(v.active_pool.where("gen = 1").select("task_number", F.col("task_number").alias("ord"))).select("task_number", "place")


@query("g06_pool_update", f"WITH {RATED}, gone AS (SELECT task_number FROM rated WHERE rate = 0 AND task_number IN (SELECT parent_number FROM tasks WHERE parent_number IS NOT NULL)), kept AS (SELECT task_number FROM pool WHERE task_number NOT IN (SELECT task_number FROM gone)) SELECT task_number FROM kept UNION SELECT task_number FROM active_pool WHERE gen = 3")
def update(v):
    replaced = replaced_parents(v)
    return p.updated(v.active_pool.where("gen = 2"), replaced, v.active_pool.where("gen = 3"))[0]


@query("g06_pool_update_report", f"WITH {RATED} SELECT count(*) FILTER (rate = 0) AS removed, count(*) FILTER (rate <> 0) AS other_replaced FROM rated WHERE task_number IN (SELECT parent_number FROM tasks WHERE parent_number IS NOT NULL)")
def update_report(v):
    replaced = replaced_parents(v)
    return p.updated(v.active_pool.where("gen = 2"), replaced, v.active_pool.where("gen = 3"))[1]


@query("g07_discard_impossible", f"WITH {RATED} SELECT task_number, difficulty FROM classed WHERE difficulty <> 'impossible' OR (SELECT count(*) FILTER (difficulty = 'impossible') >= count(*) FROM classed)")
def discard(v):
    return p.without_impossible(rated(v)).select("task_number", "difficulty")


@query("g08_prune_oldest", "SELECT task_number FROM (SELECT task_number, row_number() OVER (ORDER BY task_number DESC) AS r FROM active_pool WHERE gen = 4) x WHERE r <= 40")
def prune(v):
    return p.newest(v.active_pool.where("gen = 4").select("task_number"), 40)


@query("g09_uniform_parents", f"WITH {RATED}, ok AS (SELECT task_number, row_number() OVER (ORDER BY task_number) - 1 AS at_, count(*) OVER () AS n FROM classed WHERE difficulty IN ('hard', 'easy', 'medium')), d AS (SELECT id AS draw, {draw_sql('id', 2)} AS h FROM (SELECT unnest(range(0, 50)) AS id) x) SELECT d.draw, ok.task_number FROM d JOIN ok ON ok.at_ = d.h % ok.n")
def uniform_parents(v):
    return p.uniform_parents(rated(v), 50, lambda k: draw(k, 2))


G10 = f"""WITH {RATED}, r AS (SELECT task_number, rate, difficulty, row_number() OVER (PARTITION BY difficulty ORDER BY {draw_sql('task_number', 5)}, task_number) AS at_ FROM classed),
  c AS (SELECT count(*) FILTER (difficulty = 'impossible') AS imp, count(*) FILTER (difficulty IN ('hard', 'easy')) AS he, count(*) FILTER (difficulty = 'medium') AS med FROM r),
  q AS (SELECT least(60, imp) AS first, least(60 - least(60, imp), he) AS second, med FROM c),
  w AS (SELECT task_number, abs(rate - 0.5) + 0.000001 AS w FROM r WHERE difficulty IN ('hard', 'easy')),
  bands AS (SELECT task_number, sum(w) OVER (ORDER BY task_number) - w AS lo, sum(w) OVER (ORDER BY task_number) AS hi, sum(w) OVER () AS total FROM w),
  d AS (SELECT id AS draw, {draw_sql('id', 6)} / {float(M)} AS u FROM (SELECT unnest(range(0, 60)) AS id) x, q WHERE id < second),
  every AS (SELECT 1 AS phase, at_, task_number, 'impossible' AS how FROM r, q WHERE difficulty = 'impossible' AND at_ <= first
    UNION ALL SELECT 2, draw, task_number, 'weighted' FROM d JOIN bands ON u * total >= lo AND u * total < hi
    UNION ALL SELECT 3, at_, task_number, 'medium' FROM r, q WHERE difficulty = 'medium' AND at_ <= least(60 - first - second, med))
SELECT row_number() OVER (ORDER BY phase, at_) AS slot, task_number, how FROM every"""


@query("g10_biased_parents", G10)
def biased_parents(v):
    return p.biased_parents(rated(v), 60, lambda k: draw(k, 5), lambda k: uniform(k, 6), impossible=True)


LIMBO = "limbo AS (SELECT task_number AS child, parent_number AS parent FROM tasks WHERE parent_number IS NOT NULL)"


@query("g11_limbo_reinstatement", f"WITH {RATED}, {LIMBO}, back AS (SELECT child, parent FROM limbo WHERE child IN (SELECT task_number FROM classed WHERE difficulty = 'impossible')) SELECT task_number FROM pool WHERE task_number NOT IN (SELECT child FROM back) UNION SELECT parent FROM back")
def limbo(v):
    edges = v.tasks.where("parent_number IS NOT NULL").select(F.col("task_number").alias("child"), F.col("parent_number").alias("parent"))
    return p.reinstated(v.active_pool.where("gen = 2"), rated(v), edges)[0]


@query("g12_synced_skills", "SELECT ord, count(*) AS n, CAST(sum(points) AS BIGINT) AS points FROM points WHERE task_number IN (SELECT task_number FROM active_pool WHERE gen = 0) GROUP BY ord")
def synced(v):
    kept = p.synced(v.points, v.active_pool.where("gen = 0"))[0]
    return kept.groupBy("ord").agg(F.count("*").alias("n"), F.sum("points").alias("points"))


@query("g12_missing_tasks", "WITH g AS (SELECT m.ord, a.task_number FROM (SELECT DISTINCT ord FROM points) m CROSS JOIN active_pool a WHERE a.gen = 0) SELECT g.ord, count(*) FILTER (p.ord IS NULL) AS missing FROM g LEFT JOIN points p ON p.ord = g.ord AND p.task_number = g.task_number GROUP BY g.ord")
def missing(v):
    gone = p.synced(v.points, v.active_pool.where("gen = 0"))[1].groupBy("ord").agg(F.count("*").alias("missing"))
    return v.points.select("ord").distinct().join(gone, "ord", "left").select("ord", F.coalesce("missing", F.lit(0)).alias("missing"))


@query("g13_merged_scores", "SELECT ord, task_number, CASE WHEN NOT solved THEN points + 100 ELSE points END AS score FROM points")
def merged(v):
    old = v.points.select("ord", "task_number", F.col("points").alias("score"), "solved")
    return p.merged_scores(old, old.where("not solved").withColumn("score", F.col("score") + 100))


@query("g13_merged_evaluations", "WITH m AS (SELECT ord, task_number, CASE WHEN NOT solved AND ord < 20 THEN points + 100 ELSE points END AS score, CASE WHEN NOT solved AND ord < 20 THEN 1 ELSE 0 END AS again FROM points) SELECT ord, count(*) AS tasks, CAST(sum(score) AS BIGINT) AS total, count(*) + sum(again) AS details, round(avg(score), 6) AS fitness FROM m GROUP BY ord")
def merged_evaluations(v):
    """Models from 20 on have no result; their fitness is worked out anew all the same."""
    def scores(rows, add: int):
        return rows.select("ord", "task_number", (F.col("points") + add).alias("score"))

    def details(rows):
        return rows.select("ord", F.col("task_number").cast("string").alias("task_id"))

    again = v.points.where("not solved and ord < 20")
    _, both, models = p.merged_evaluations(scores(v.points, 0), details(v.points), scores(again, 100), details(again))
    shown = both.groupBy("ord").agg(F.count("*").alias("details"))
    return models.join(shown, "ord", "left").select("ord", "tasks", "total", F.coalesce("details", F.lit(0)).alias("details"), F.round("fitness", 6).alias("fitness"))


@query("g12_same_missing", "WITH g AS (SELECT m.ord, string_agg(CASE WHEN p.ord IS NULL THEN CAST(a.task_number AS STRING) END, ',' ORDER BY a.task_number) AS missing FROM (SELECT DISTINCT ord FROM points) m CROSS JOIN (SELECT task_number FROM active_pool WHERE gen = 0) a LEFT JOIN points p ON p.ord = m.ord AND p.task_number = a.task_number GROUP BY m.ord) SELECT count(DISTINCT coalesce(missing, '')) <= 1 AS same FROM g")
def same_missing(v):
    return p.same_missing(v.points, v.active_pool.where("gen = 0"))


@query("g14_resumed_pool", "WITH valid AS (SELECT task_number FROM active_pool WHERE gen = 3), good AS (SELECT gen FROM active_pool GROUP BY gen HAVING bool_and(task_number IN (SELECT task_number FROM valid))) SELECT gen, task_number, (SELECT max(task_number) + 1 FROM valid) AS next_number FROM active_pool WHERE gen = (SELECT max(gen) FROM good)")
def resumed(v):
    return p.resumed(v.active_pool, v.active_pool.where("gen = 3").select("task_number"))


@query("g15_valid_tasks", "SELECT task_number, task_id FROM tasks WHERE task_number IN (SELECT task_number FROM active_pool)")
def valid(v):
    return v.tasks.join(v.active_pool.select("task_number"), "task_number", "left_semi").select("task_number", "task_id")


NEAR = "near AS (SELECT a.vec_id AS candidate, b.vec_id AS earlier FROM embeddings a JOIN embeddings b ON b.vec_id < a.vec_id AND list_cosine_similarity(a.embedding, b.embedding) >= 0.35)"


def near(v):
    return with_earlier(v.embeddings.select(F.col("vec_id").alias("sample_id"), "embedding"), 0.35).select(F.col("sample_id").alias("candidate"))


@query("g16_judged_queue", f"WITH {NEAR}, good AS (SELECT vec_id AS candidate, row_number() OVER (ORDER BY vec_id) AS place FROM embeddings WHERE vec_id NOT IN (SELECT candidate FROM near) OR label = 3) SELECT candidate, place FROM good WHERE place <= 10")
def judged_queue(v):
    c = v.embeddings.select(F.col("vec_id").alias("candidate"), F.when(F.col("label") == 3, "Yes").otherwise("No").alias("verdict"))
    return p.initial_queue(c.select("candidate"), near(v), 10, c)


@query("g16_novelty_gate", f"WITH {NEAR} SELECT vec_id AS candidate FROM embeddings WHERE vec_id NOT IN (SELECT candidate FROM near) OR label = 3")
def gate(v):
    c = v.embeddings.select(F.col("vec_id").alias("candidate"), F.when(F.col("label") == 3, "Yes").otherwise("No").alias("verdict"))
    return p.novel_candidates(c.select("candidate"), near(v), c)


@query("g16_initial_queue", f"WITH {NEAR}, good AS (SELECT vec_id AS candidate, row_number() OVER (ORDER BY vec_id) AS place FROM embeddings WHERE vec_id NOT IN (SELECT candidate FROM near)) SELECT candidate, place FROM good WHERE place <= 10")
def queue(v):
    return p.initial_queue(v.embeddings.select(F.col("vec_id").alias("candidate")), near(v), 10)


def stored_tasks(v):
    """Tasks with a vector: other, embedding, fields, content."""
    fields = F.create_map(F.lit("task_family"), F.lit("x"), F.lit("name_of_task"), F.col("source"), F.lit("estimated_human_difficulty"), F.col("lang"))
    rows = v.documents.select(F.col("doc_id").alias("other"), fields.alias("fields"), F.col("text").alias("content"))
    return rows.join(v.embeddings.select(F.col("vec_id").alias("other"), "embedding"), "other")


def asked_tasks(v):
    return v.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("candidate"), "embedding")


SHOWN = """kept AS (SELECT doc_id, text, embedding, concat('Task description: ', chr(10), 'Name of task: ', source, chr(10), 'Estimated human difficulty: ', lang, chr(10), chr(10)) AS about,
    concat('Task code: ', chr(10), text, chr(10)) AS code FROM documents JOIN embeddings ON vec_id = doc_id),
  shown AS (SELECT doc_id, concat('[[START OF ADDITIONAL EXISTING TASK]]', chr(10), {parts}, '[[END OF ADDITIONAL EXISTING TASK]]', chr(10), chr(10)) AS block FROM kept),
  asked AS (SELECT vec_id AS candidate, embedding FROM embeddings WHERE vec_id % 20 = 0)"""
NEAREST = """hits AS (SELECT candidate, doc_id AS other, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(k.embedding AS DOUBLE[])) AS similarity FROM asked a CROSS JOIN kept k),
  ranked AS (SELECT candidate, other, row_number() OVER (PARTITION BY candidate ORDER BY round(similarity, 12) DESC, other) AS rank FROM hits WHERE similarity >= 0)"""


def context_sql(parts: str, n: int) -> str:
    return f"WITH {SHOWN.format(parts=parts)}, {NEAREST}, t AS (SELECT candidate, string_agg(block, '' ORDER BY rank) AS context FROM ranked JOIN shown ON doc_id = other WHERE rank <= {n} GROUP BY candidate) SELECT a.candidate, md5(coalesce(context, '')) AS context FROM asked a LEFT JOIN t USING (candidate)"


def similar_context(v, representation: str, n: int):
    tasks, asked = stored_tasks(v), asked_tasks(v)
    near = p.similar_tasks(tasks.select(F.col("other").alias("sample_id"), "embedding"), asked, n)
    return p.context_rows(asked, near, tasks, representation).select("candidate", F.md5("context").alias("context"))


@query("g17_context_rows", context_sql("about", 3))
def context(v):
    return similar_context(v, "metadata", 3)


@query("g17_context_of_code", context_sql("code", 2))
def context_of_code(v):
    return similar_context(v, "content", 2)


@query("g17_context_of_both", context_sql("about, code", 1))
def context_of_both(v):
    return similar_context(v, "all", 1)


@query("g17_random_context", f"WITH {SHOWN.format(parts='about')}, pool AS (SELECT doc_id AS other, row_number() OVER (ORDER BY doc_id) - 1 AS at_, count(*) OVER () AS n FROM kept), d AS (SELECT candidate, {draw_sql('candidate', 21)} % (n - 2) AS a, {draw_sql('candidate', 22)} % (n - 1) AS b, {draw_sql('candidate', 23)} % n AS c, n FROM asked, (SELECT count(*) AS n FROM kept) x), e AS (SELECT candidate, a, CASE WHEN b = a THEN n - 2 ELSE b END AS b, c, n FROM d), f AS (SELECT candidate, a, b, CASE WHEN c IN (a, b) THEN n - 1 ELSE c END AS c FROM e), g AS (SELECT candidate, 1 AS rank, a AS at_ FROM f UNION ALL SELECT candidate, 2, b FROM f UNION ALL SELECT candidate, 3, c FROM f) SELECT candidate, md5(string_agg(block, '' ORDER BY rank)) AS context FROM g JOIN pool USING (at_) JOIN shown ON doc_id = other GROUP BY candidate")
def random_context(v):
    """Three tasks of the pool at random for each candidate."""
    tasks, asked = stored_tasks(v), asked_tasks(v)
    near = p.random_tasks(asked, tasks.select(F.col("other").alias("task_number")), 3, lambda c, i: draw(c, 21 + i))
    return p.context_rows(asked, near, tasks).select("candidate", F.md5("context").alias("context"))


@query("g18_seed_exclusion", "SELECT task_number FROM tasks WHERE generation_type <> 'initial'")
def seeds(v):
    return p.without_seeds(v.tasks, v.tasks.where("generation_type = 'initial'")).select("task_number")


@query("m03_initial_truncation", "SELECT task_number FROM (SELECT task_number, row_number() OVER (ORDER BY task_number) AS r FROM active_pool WHERE gen = 4) x WHERE r <= 30")
def truncation(v):
    return p.oldest(v.active_pool.where("gen = 4").select("task_number"), 30)


