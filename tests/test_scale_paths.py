"""Paths that make plans grow well, each against the plain way to the same rows."""

import io
from contextlib import redirect_stdout

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from evalspark.functions.hashing import draw, set_digest, uniform
from evalspark.operators import coverage, evolution, order, pool

SAMPLES = "benchmark string, filter string, model_name string, sample_id long, correct boolean"


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("simple")
    return out.getvalue()


def rows_of(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.fixture(scope="module")
def samples(spark):
    """Three keys, 150 models (three words of bits) of which some have no row for a sample."""
    r = np.random.default_rng(1)
    rows = [(b, "f", f"m{m:03}", s, bool(r.random() < 0.02 + (m % 5) * 0.05)) for b in ("x", "y", "z") for m in range(150) for s in range(12) if r.random() < 0.8]
    return spark.createDataFrame(rows, SAMPLES).cache()


def joined_sweep(samples, selection, by):
    """Every sample beside every selection that names its model, then one grouping after the other."""
    sized = selection.distinct().withColumn("models", F.count("*").over(Window.partitionBy(*by)))
    where = [*by, *coverage.KEYS]
    per = samples.join(sized, "model_name").groupBy(*where, "models", "sample_id").agg(F.count_if("correct").alias("solvers"), F.min(F.when(F.col("correct"), F.col("model_name"))).alias("one"))
    alone = per.where("solvers = 1").groupBy(*where, F.col("one").alias("model_name")).agg(F.count("*").alias("unique_contribution"))
    each = samples.join(sized, "model_name").where("correct").groupBy(*where, "model_name").agg(F.count("*").alias("contribution"))
    return coverage.rates(per, where), each.join(alone, [*where, "model_name"], "left").withColumn("unique_contribution", F.coalesce("unique_contribution", F.lit(0)))


def test_sweep_equals_joins(spark, samples):
    r = np.random.default_rng(2)
    picked = [(f"s{i}", f"m{m:03}") for i in range(40) for m in r.choice(152, r.integers(1, 30), replace=False)]  # two models have no row
    selection = spark.createDataFrame(picked + picked[:5], "method string, model_name string")
    got, want = coverage.sweep(samples, selection, ["method"]), joined_sweep(samples, selection, ["method"])
    columns = ["method", *coverage.KEYS, "num_samples", "covered", "majority", "unique_solved", "coverage_accuracy"]
    assert rows_of(got[0], columns) == rows_of(want[0], columns)
    columns = ["method", *coverage.KEYS, "model_name", "contribution", "unique_contribution"]
    assert rows_of(got[1], columns) == rows_of(want[1], columns)
    shares = got[1].groupBy("method", *coverage.KEYS).agg(F.sum("unique_contribution").alias("n"), F.max("covered").alias("c")).where("n > c").count()
    assert shares == 0


def test_sweep_of_a_thousand_selections_shuffles_samples_once(spark, samples):
    """One row a sample whatever the number of selections; behind the masks only partial sums are shuffled."""
    selection = spark.range(1000).select(F.col("id").alias("n"), F.explode(F.array(*(F.concat(F.lit("m"), F.lpad(((F.col("id") * k) % 150).cast("string"), 3, "0")) for k in (1, 3, 7)))).alias("model_name"))
    bits = coverage.solver_bits(samples, [f"m{m:03}" for m in range(150)])
    assert plan(bits).count("Exchange hashpartitioning") == 1
    assert bits.count() == samples.select(*coverage.KEYS, "sample_id").distinct().count()
    covered = coverage.sweep(samples, selection, ["n"])[0]
    text = plan(covered)
    assert text.count("Exchange hashpartitioning") <= 2 and "SortMergeJoin" not in text and "partial_count" in text.split("BroadcastNestedLoopJoin")[0]
    assert covered.groupBy("n").count().count() == 1000


def test_sweep_edges(spark, samples):
    twice = samples.limit(3).union(samples.limit(3))
    with pytest.raises(Exception, match="duplicate sample"):
        coverage.sweep(twice, samples.select(F.lit(1).alias("n"), "model_name").distinct(), ["n"])[0].collect()
    none = samples.select(F.lit(1).alias("n"), "model_name").limit(0)
    assert [x.count() for x in coverage.sweep(samples, none, ["n"])] == [0, 0]
    assert coverage.sweep(samples.limit(0), samples.select(F.lit(1).alias("n"), "model_name").distinct(), ["n"])[0].count() == 0


@pytest.fixture(scope="module")
def spread(spark):
    """Rows over many ranges: one key has most of them, ties, null keys."""
    r = np.random.default_rng(3)
    rows = [(i, None if i % 11 == 0 else "hot" if i % 3 else "cold", int(r.integers(0, 50)), float(r.random()) + 0.01) for i in range(2000)]
    return spark.createDataFrame(rows, "id long, key string, x long, w double").repartition(7).cache()


def test_places_equal_a_window(spread):
    got = order.placed(spread, ["x", "id"], keys=["key"])
    want = spread.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("x", "id")))
    assert rows_of(got, ["id", "place"]) == rows_of(want, ["id", "place"])
    whole = order.placed(spread, [F.desc("x"), "id"], start=0)
    want = spread.withColumn("place", F.row_number().over(Window.orderBy(F.desc("x"), "id")) - 1)
    assert rows_of(whole, ["id", "place"]) == rows_of(want, ["id", "place"])
    assert "SinglePartition" not in plan(whole) and "Window" not in plan(whole)
    assert order.placed(spread.limit(0), ["x"]).count() == 0


def test_draws_equal_cumulated_weights(spark, spread):
    draws = spark.range(500).select(F.col("id").alias("draw"), uniform(F.col("id"), 3).alias("u"))
    got = order.drawn(spread.select("id", "w"), ["id"], "w", draws, "u")
    w = [r["w"] for r in spread.orderBy("id").collect()]
    ends = np.cumsum(w)
    want = sorted((r["draw"], int(np.searchsorted(ends, r["u"] * ends[-1], side="right"))) for r in draws.collect())
    assert sorted((r["draw"], r["id"]) for r in got.collect()) == want
    assert order.drawn(spread.select("id", "w").limit(0), ["id"], "w", draws, "u").count() == 0
    assert order.drawn(spread.select("id", "w"), ["id"], "w", draws.limit(0), "u").count() == 0


def test_parents_are_drawn_without_a_single_task(spark):
    """The weighted draw against its rule as a loop; no plan step holds the pool."""
    rated = spark.range(3000).select(F.col("id").alias("task_number"), (F.col("id") % 9 / 8).alias("rate")).withColumn("difficulty", pool.difficulty(F.col("rate")))
    got = pool.biased_parents(rated, 2500, lambda k: draw(k, 1), lambda k: uniform(k, 2))
    rows = got.orderBy("slot").collect()
    assert [r["slot"] for r in rows] == list(range(1, 2501))
    tasks = [(r["task_number"], abs(r["rate"] - 0.5) + 1e-6) for r in rated.where("difficulty in ('hard', 'easy')").orderBy("task_number").collect()]
    ends = np.cumsum([w for _, w in tasks])
    u = [r["u"] for r in spark.range(len(tasks)).select(uniform(F.col("id"), 2).alias("u")).collect()]
    want = [tasks[int(np.searchsorted(ends, x * ends[-1], side="right"))][0] for x in u]
    weighted = [r["task_number"] for r in rows if r["how"] == "weighted"]
    assert sum(a != b for a, b in zip(weighted, want, strict=True)) <= 1  # sums in another order may differ at a bound
    medium = [r["task_number"] for r in rows if r["how"] == "medium"]
    assert len(medium) == len(set(medium)) == 2500 - len(tasks)
    text = plan(got)
    assert text.count("SinglePartition") <= 2 and "CartesianProduct" not in text  # the table of ranges alone


def test_set_digests(spark):
    sets = {0: [1, 2, 3], 1: [3, 2, 1], 2: [1, 2], 3: [1, 2, 4], 4: [1, 2, 4], 5: [5]}
    df = spark.createDataFrame([(g, t) for g, ts in sets.items() for t in ts], "gen long, task_number long").repartition(5)
    digests = {r["gen"]: r["d"] for r in df.groupBy("gen").agg(set_digest("task_number").alias("d")).collect()}
    assert digests[0] == digests[1] and digests[3] == digests[4] and len(set(digests.values())) == 4
    changes, step = evolution.change_points(df)
    assert sorted((r["gen"], r["change"]) for r in changes.collect()) == [(0, 1), (2, 2), (3, 3), (5, 4)] and step.first()["step"] == 1
    assert "collect_set" not in plan(changes)


def test_missing_tasks(spark):
    skills = spark.createDataFrame([(0, 1), (0, 2), (1, 1), (1, 2), (2, 9)], "ord long, task_number long")
    tasks = spark.createDataFrame([(1,), (2,), (3,)], "task_number long")
    kept, missing = pool.synced(skills, tasks)
    assert sorted(map(tuple, missing.collect())) == [(0, 3), (1, 3), (2, 1), (2, 2), (2, 3)] and kept.count() == 4
    assert not pool.same_missing(skills, tasks).first()["same"]
    assert pool.same_missing(skills.where("ord < 2"), tasks).first()["same"]


def test_lines_of_split_files(spark, tmp_path):
    """One file over many splits and tasks: lines keep their order, and of two lines with one key the later one counts."""
    from evalspark.sources import harness
    from evalspark.sources.files import read_texts

    folder = tmp_path / "model"
    folder.mkdir()
    numbers = [(i * 37) % 200 for i in range(400)]
    lines = [f'{{"doc_id": {n}, "filter": "{"flexible-extract" if i % 2 else "x"}", "exact_match": {int(i >= 200)}, "pad": "{"p" * (i % 50)}"}}' for i, n in enumerate(numbers)]
    (folder / "samples_gsm8k_2025.jsonl").write_text("\n".join(lines) + "\n")
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    try:
        spark.conf.set(names[0], "3000")
        spark.conf.set(names[1], "1")
        text = read_texts(spark, str(tmp_path), "samples")
        assert text.select("line.split").distinct().count() > 5
        ordered = order.placed(text, ["line"], "n", ["file_name"], start=0).select("n", "value")
        assert sorted(map(tuple, ordered.collect())) == list(enumerate(lines))
        rows = harness.read_samples(spark, str(tmp_path), "gsm8k")
        of = harness.filtered_population(rows, "flexible-extract").select("ord", F.try_variant_get("v", "$.doc_id", "int").alias("n"))
        assert [r["n"] for r in of.orderBy("ord").collect()] == numbers[1::2]
        last = {n: i for i, n in enumerate(numbers) if i % 2}
        got = {int(r["sample_id"]): r["correct"] for r in harness.normalized(rows, "gsm8k").collect()}
        assert got == {n: i >= 200 for n, i in last.items()}
    finally:
        for n, x in zip(names, before, strict=True):
            spark.conf.set(n, x)


def test_lineage_of_a_long_chain(spark, tmp_path):
    """A chain of 1,000, a diamond and a cycle: every pair once, and written once."""
    from pathlib import Path

    chain = [(f"c{i:04}", f"c{i - 1:04}") for i in range(1, 1000)]
    diamond = [("d3", "d1"), ("d3", "d2"), ("d1", "d0"), ("d2", "d0"), ("d0", "c0005"), ("d3", "d1")]
    ring = [("r0", "r1"), ("r1", "r2"), ("r2", "r0")]
    edges = spark.createDataFrame(chain + diamond + ring, "child string, parent string")
    models = spark.createDataFrame([("c0999",), ("c0500",), ("d3",), ("r0",)], "child string")
    want = {("c0999", f"c{i:04}") for i in range(999)} | {("c0500", f"c{i:04}") for i in range(500)}
    want |= {("d3", x) for x in ("d0", "d1", "d2", *(f"c{i:04}" for i in range(6)))} | {("r0", f"r{i}") for i in range(3)}
    got = evolution.lineage(edges, models)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    parts = {str(Path(f).parent) for f in got.inputFiles()}
    assert len(parts) <= 12 and sum(spark.read.parquet(p).count() for p in parts) == len(want)


def test_cumulative_entropy_equals_copies(spark):
    """Embeddings that change, tasks that come late, a generation without rows, against copying every row into all later ones."""
    from evalspark.operators import vectors

    r = np.random.default_rng(8)
    rows = [(g, t, [float(x) for x in r.normal(size=5)]) for g in (0, 1, 3) for t in range(30) if r.random() < 0.5] + [(3, 99, [1.0, 0.0, 0.0, 0.0, 0.0]), (1, 99, [1.0, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "gen long, task_number long, embedding array<double>")
    gens = spark.createDataFrame([(g,) for g in (0, 1, 2, 3, 5)], "gen long")
    upto = df.withColumnRenamed("gen", "seen").join(gens, F.col("seen") <= F.col("gen")).groupBy("gen", "task_number").agg(F.max_by("embedding", "seen").alias("embedding"))
    want = {x["gen"]: (x["n"], x["score"]) for x in vectors.gram_entropy(upto, "gen", 0.5).collect()}
    got = {x["gen"]: (x["n"], x["score"]) for x in vectors.cumulative_entropy(df, gens, 0.5).collect()}
    assert got.keys() == want.keys() and all(got[g][0] == want[g][0] and abs(got[g][1] - want[g][1]) < 1e-6 for g in want)
