"""Dominated-novelty queries."""

from pyspark.sql import functions as F

from evalspark.operators import novelty as n
from evalspark.operators.skills import difficulty_weights
from evalspark.plans.registry import query
from evalspark.plans.skills import BITS, bits_of as grid_bits
from evalspark.sources.tables import Tables

MODELS = "models AS (SELECT ord, model_path, CAST(round(fitness * 20) AS BIGINT) AS fitness FROM archive)"
FITTER = """p AS (SELECT min(ord) AS p FROM models WHERE fitness = (SELECT max(fitness) FROM models)),
  fitter AS (SELECT s.ord AS s, f.ord AS f FROM models s CROSS JOIN p JOIN models f
    ON CASE WHEN s.ord > p.p THEN f.fitness >= s.fitness AND f.model_path <> s.model_path ELSE f.fitness > s.fitness END)"""


def ratios(limit="", weight="1"):
    return f"""ratios AS (SELECT s, f, 
    CASE WHEN sum(CASE WHEN NOT b.solved THEN {weight} ELSE 0 END) > 0 THEN 100.0 * sum(CASE WHEN a.solved AND NOT b.solved THEN {weight} ELSE 0 END) / sum(CASE WHEN NOT b.solved THEN {weight} ELSE 0 END) ELSE 0.0 END AS ratio,
    100.0 * sum(CASE WHEN a.solved AND NOT b.solved THEN {weight} ELSE 0 END) / sum({weight}) AS ratio_full
    FROM fitter JOIN bits a ON a.ord = s JOIN bits b ON b.ord = f AND b.pos = a.pos {limit} GROUP BY s, f)"""


SCORES = """ranked AS (SELECT s, ratio, row_number() OVER (PARTITION BY s ORDER BY ratio) AS r FROM ratios),
  scores AS (SELECT m.ord, m.model_path, m.fitness, coalesce(x.novelty, 999.0) AS novelty FROM models m LEFT JOIN (SELECT s, sum(ratio) / count(*) AS novelty FROM ranked WHERE r <= 3 GROUP BY s) x ON x.s = m.ord)"""


def models(v):
    """The population, written once: it is read for the fittest, for pairs and for the result."""
    return Tables(v.spark).save(v.archive.select("ord", "model_path", F.round(F.col("fitness") * 20).cast("bigint").alias("fitness")), "models")


def bits_of(v):
    return Tables(v.spark).save(grid_bits(v), "bits")


@query("e01_hamming", f"WITH {BITS} SELECT a.ord AS a, b.ord AS b, count(*) FILTER (a.solved <> b.solved) AS distance FROM bits a JOIN bits b ON a.pos = b.pos AND a.ord < b.ord GROUP BY ALL")
def hamming(v):
    return n.hamming(bits_of(v))


@query("e02_unique_skill_ratio", f"WITH {MODELS}, {BITS}, {FITTER}, {ratios()} SELECT s, f, ratio FROM ratios")
def ratio(v):
    return n.pair_ratios(bits_of(v), n.fitter(models(v))).select("s", "f", "ratio")


@query("e03_ratio_to_full", f"WITH {MODELS}, {BITS}, {FITTER}, {ratios()} SELECT s, f, ratio_full FROM ratios")
def ratio_full(v):
    return n.pair_ratios(bits_of(v), n.fitter(models(v))).select("s", "f", "ratio_full")


@query("e04_weighted_ratio", f"WITH {MODELS}, {BITS}, {FITTER}, w AS (SELECT pos, count(*) FILTER (NOT solved) AS weight FROM bits GROUP BY pos), {ratios('JOIN w ON w.pos = a.pos', 'weight')} SELECT s, f, round(ratio, 9) AS ratio, round(ratio_full, 9) AS ratio_full FROM ratios")
def weighted(v):
    bits = bits_of(v)
    w = difficulty_weights(bits)
    return n.pair_ratios(bits, n.fitter(models(v)), w).select("s", "f", F.round("ratio", 9).alias("ratio"), F.round("ratio_full", 9).alias("ratio_full"))


@query("e05_prefix_ratio", f"WITH {MODELS}, {BITS}, {FITTER}, {ratios('JOIN (SELECT unnest(range(0, 20)) AS k) lim ON lim.k = a.pos')} SELECT s, f, ratio, ratio_full FROM ratios")
def prefix(v):
    return n.pair_ratios(bits_of(v), n.fitter(models(v)), limit=20)


@query("e06_fitter_sets", f"WITH {MODELS}, {FITTER} SELECT s, f FROM fitter")
def fitter(v):
    return n.fitter(models(v))


@query("e07_novelty_score", f"WITH {MODELS}, {BITS}, {FITTER}, {ratios()}, {SCORES} SELECT ord, round(novelty, 9) AS novelty FROM scores")
def novelty(v):
    return n.novelty(models(v), bits_of(v)).select("ord", F.round("novelty", 9).alias("novelty"))


@query("e08_novelty_top_n", f"WITH {MODELS}, {BITS}, {FITTER}, {ratios()}, {SCORES}, r AS (SELECT ord, model_path, row_number() OVER (ORDER BY round(novelty, 9) DESC, ord) AS rank FROM scores) SELECT ord, model_path, rank FROM r WHERE rank <= 16")
def top(v):
    m = models(v)
    scored = n.novelty(m.where("ord < 20").unionByName(m.where("ord >= 20")), bits_of(v)).withColumn("novelty", F.round("novelty", 9))
    return n.keep_best(scored, "novelty", 16).select("ord", "model_path", "rank")


@query("e09_fitness_top_n", f"WITH {MODELS}, r AS (SELECT ord, model_path, row_number() OVER (ORDER BY fitness DESC, ord) AS rank FROM models) SELECT ord, model_path, rank FROM r WHERE rank <= 16")
def fittest(v):
    m = models(v)
    return n.updated_archive(m.where("ord < 20"), m.where("ord >= 20"), bits_of(v), 16, by_fitness=True).select("ord", "model_path", "rank")
