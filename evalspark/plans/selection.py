"""Model-subset selection queries."""

from pyspark.sql import functions as F

from evalspark.functions.hashing import draw, draw_sql
from evalspark.functions.text import is_seed_model
from evalspark.operators import selection as s
from evalspark.operators.skills import binarize
from evalspark.plans.registry import query

FIT = "fit AS (SELECT gen, ord, model_path, CAST(round(fitness * 1000) AS BIGINT) AS fitness FROM archive)"


def fit(v):
    return v.archive.select("gen", "ord", "model_path", F.round(F.col("fitness") * 1000).cast("bigint").alias("fitness"))


def solved(v):
    """Entries at 0.8 or more keep their score, others are 0: a task set that no model covers alone."""
    return v.points.withColumn("score", F.when(F.col("points") >= 45, F.col("points")).otherwise(0))


def greedy_sql(n: int, by: str = "", view: str = "points") -> str:
    """n greedy picks as nested queries."""
    part = f"PARTITION BY {by}" if by else ""
    k = f"{by}, " if by else ""
    on = f"AND a.{by} = b.{by}" if by else ""
    text = f"WITH hits AS (SELECT {k}ord, task_number FROM {view} WHERE points >= 45), all_models AS (SELECT DISTINCT {k}ord, model_path FROM {view})"
    for i in range(1, n + 1):
        gone = " ".join(f"AND NOT EXISTS (SELECT 1 FROM hits b JOIN pick{j} q ON q.ord = b.ord {f'AND q.{by} = b.{by}' if by else ''} WHERE b.task_number = a.task_number {on})" for j in range(1, i))
        free = " ".join(f"AND NOT EXISTS (SELECT 1 FROM pick{j} q WHERE q.ord = m.ord {f'AND q.{by} = m.{by}' if by else ''})" for j in range(1, i))
        text += f""", gain{i} AS (SELECT {k}ord, count(*) AS gain FROM hits a WHERE true {gone} GROUP BY ALL),
          pick{i} AS (SELECT * FROM (SELECT {'m.' + by + ', ' if by else ''}{i} AS pick, m.ord, m.model_path, coalesce(g.gain, 0) AS gain,
            row_number() OVER ({part.replace(by, 'm.' + by) if by else ''} ORDER BY coalesce(g.gain, 0) DESC, m.ord) AS r
            FROM all_models m LEFT JOIN gain{i} g ON g.ord = m.ord {f'AND g.{by} = m.{by}' if by else ''} WHERE true {free}) x WHERE r = 1)"""
    return text + " " + " UNION ALL ".join(f"SELECT {k}pick, ord, model_path, gain FROM pick{i}" for i in range(1, n + 1))


@query("f01_greedy_cover", greedy_sql(4))
def greedy(v):
    return s.greedy_cover(solved(v), 4)


@query("f01_greedy_cover_per_generation", greedy_sql(3, "gen"))
def greedy_per_generation(v):
    return s.greedy_cover(solved(v), 3, by=["gen"])


BITS = "bits AS (SELECT m.ord, t.task_number AS pos, coalesce(p.points, 0) >= 45 AS solved FROM (SELECT DISTINCT ord FROM points) m CROSS JOIN (SELECT DISTINCT task_number FROM points) t LEFT JOIN points p ON p.ord = m.ord AND p.task_number = t.task_number)"


@query("f02_optimal_cover", f"WITH {BITS}, pairs AS (SELECT a.ord AS a, b.ord AS b, count(*) FILTER (a.solved OR b.solved) AS covered FROM bits a JOIN bits b ON a.pos = b.pos AND a.ord < b.ord GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY covered DESC, a, b) AS k FROM pairs) SELECT concat(CAST(a AS STRING), ',', CAST(b AS STRING)) AS members, covered FROM r WHERE k = 1")
def optimal(v):
    models = v.points.select("ord", "model_path").distinct()
    pool = v.points.select("task_number").distinct()
    bits = binarize(models, pool, v.points.withColumn("score", F.col("points")), 45)
    return s.optimal_cover(bits, 2).select(F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"), "covered")


@query("f02_optimal_six", f"WITH RECURSIVE {BITS}, pos AS (SELECT pos, CAST(sum(CASE WHEN solved THEN 1::BIGINT << CAST(ord - 16 AS INT) ELSE 0 END) AS BIGINT) AS mask FROM bits WHERE ord >= 16 GROUP BY pos), pats AS (SELECT mask, count(*) AS n FROM pos WHERE mask <> 0 GROUP BY mask), sets AS (SELECT CAST(o AS INT) AS last, 1::BIGINT << CAST(o AS INT) AS picked, 1 AS size FROM (SELECT unnest(range(0, 16)) AS o) x UNION ALL SELECT CAST(o AS INT), picked | (1::BIGINT << CAST(o AS INT)), size + 1 FROM sets, (SELECT unnest(range(0, 16)) AS o) x WHERE o > last AND size < 6), r AS (SELECT picked, sum(n) FILTER (mask & picked <> 0) AS covered FROM sets, pats WHERE size = 6 GROUP BY picked), named AS (SELECT array_to_string(list_transform(list_filter(range(0, 16), lambda o: (picked >> CAST(o AS INT)) & 1 = 1), lambda o: CAST(o + 16 AS STRING)), ',') AS members, list_filter(range(0, 16), lambda o: (picked >> CAST(o AS INT)) & 1 = 1) AS places, CAST(covered AS BIGINT) AS covered FROM r) SELECT members, covered FROM named ORDER BY covered DESC, places LIMIT 1")
def optimal_six(v):
    """Six of the models from place 16 on; the SQL tries every subset."""
    rows = v.points.where("ord >= 16")
    bits = binarize(rows.select("ord", "model_path").distinct(), v.points.select("task_number").distinct(), rows.withColumn("score", F.col("points")), 45)
    return s.optimal_cover(bits, 6).select(F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"), "covered")


@query("f03_top_by_fitness", f"WITH {FIT}, r AS (SELECT ord, model_path, row_number() OVER (ORDER BY fitness DESC, gen, ord) AS rank FROM fit) SELECT ord, model_path, rank FROM r WHERE rank <= 8")
def top(v):
    return s.top_n(fit(v), 8).select("ord", "model_path", "rank")


@query("f04_top_across_archives", f"WITH {FIT}, pooled AS (SELECT gen, ord, model_path, fitness FROM fit UNION ALL SELECT gen + 1, ord, model_path, fitness FROM fit WHERE ord % 2 = 0), r AS (SELECT gen, model_path, row_number() OVER (ORDER BY fitness DESC, gen, ord) AS rank FROM pooled) SELECT gen, model_path, rank FROM r WHERE rank <= 8")
def across(v):
    rows = fit(v)
    return s.top_n(rows.unionByName(rows.where("ord % 2 = 0").withColumn("gen", F.col("gen") + 1)), 8).select("gen", "model_path", "rank")


@query("f05_random_n", f"WITH {FIT}, r AS (SELECT ord, model_path, row_number() OVER (ORDER BY {draw_sql('ord', 4)}, ord) AS rank FROM fit) SELECT ord, concat('/models/', model_path) AS model_path, rank FROM r WHERE rank <= 6")
def random(v):
    return s.random_n(fit(v), 6, draw(F.col("ord"), 4), "/models").select("ord", "model_path", "rank")


@query("f06_stored_vector_selection", f"WITH {FIT}, a AS (SELECT ord, model_path, gen, CASE WHEN model_path = 'gen_1_ind_0' THEN CAST('Infinity' AS DOUBLE) ELSE fitness END AS fitness FROM fit WHERE gen <= 5 AND model_path <> 'gen_2_ind_1'), r AS (SELECT ord, model_path, row_number() OVER (ORDER BY fitness DESC, gen, ord) AS rank FROM a) SELECT ord, model_path, rank FROM r WHERE rank <= 5")
def stored(v):
    return s.top_n(s.adjusted_fitness(fit(v), ["gen_1_ind_0"], ["gen_2_ind_1"], 5), 5).select("ord", "model_path", "rank")


@query("f07_best_generation", f"WITH g AS ({greedy_sql(2, 'gen')}), t AS (SELECT gen, CAST(sum(gain) AS BIGINT) AS covered FROM g GROUP BY gen), b AS (SELECT gen, covered FROM (SELECT *, row_number() OVER (ORDER BY covered DESC, gen) AS r FROM t) x WHERE r = 1), n AS (SELECT b.gen, covered, model_path, row_number() OVER (ORDER BY model_path) AS rank FROM b JOIN (SELECT DISTINCT gen, model_path FROM points) m USING (gen)) SELECT gen, covered, model_path, rank FROM n WHERE rank <= 2")
def best_generation(v):
    return s.best_generation(solved(v), 2)


@query("f08_generation_mix", f"WITH {FIT}, r AS (SELECT gen, ord, model_path, row_number() OVER (PARTITION BY gen ORDER BY fitness DESC, ord) AS rank FROM fit) SELECT gen, ord, model_path, rank FROM r WHERE (gen = 0 AND rank <= 1) OR (gen = 3 AND rank <= 2) OR (gen = 5 AND rank <= 1)")
def mix(v):
    return s.generation_mix(s.top_n(fit(v), 8, by=["gen"]), [0, 3, 3, 5], 4).select("gen", "ord", "model_path", "rank")


@query("f09_seen_tasks", "SELECT ord, count(*) AS n, CAST(sum(points) AS BIGINT) AS points FROM points WHERE task_number IN (SELECT task_number FROM active_pool WHERE gen <= 1) GROUP BY ord")
def seen(v):
    return s.seen_tasks(v.points, v.active_pool, 1).groupBy("ord").agg(F.count("*").alias("n"), F.sum("points").alias("points"))


@query("f10_union_of_selections", f"WITH {FIT}, a AS (SELECT model_path FROM (SELECT model_path, row_number() OVER (ORDER BY fitness DESC, gen, ord) AS r FROM fit) x WHERE r <= 4), b AS (SELECT model_path FROM (SELECT model_path, row_number() OVER (ORDER BY {draw_sql('ord', 4)}, ord) AS r FROM fit) x WHERE r <= 4) SELECT model_path FROM a UNION SELECT model_path FROM b")
def union(v):
    return s.union_of(s.top_n(fit(v), 4), s.random_n(fit(v), 4, draw(F.col("ord"), 4)))


@query("f11_stored_selection", "SELECT DISTINCT model_name FROM samples WHERE correct AND ord < 4")
def lookup(v):
    found = v.samples.where("correct AND ord < 4").select(F.lit("fitness").alias("method"), F.lit(4).alias("n"), "model_name")
    return s.stored_selection(found, "fitness", 4)


@query("f12_seed_models", "SELECT ord, false AS seed FROM archive")
def seeds(v):
    return v.archive.select("ord", is_seed_model(F.col("model_path")).alias("seed"))
