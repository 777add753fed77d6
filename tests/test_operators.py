"""Hand-made inputs with answers worked out by hand, for what SQL on the tables does not show."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.functions import text as t
from evalspark.functions.hashing import draw, uniform
from evalspark.operators import answers, balls, coverage, novelty, pool, selection, skills, vectors
from evalspark.sources import archives, harness
from evalspark.streaming.ingest import current, upsert_stream


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_duplicate_sample_is_an_error(spark):
    rows = spark.createDataFrame([("b", "f", "m", 1, True)] * 2, "benchmark string, filter string, model_name string, sample_id long, correct boolean")
    with pytest.raises(Exception, match="duplicate sample"):
        coverage.coverage(rows).collect()


def test_majority_counts_models_without_the_sample(spark):
    rows = [("b", "f", m, s, True) for m, s in (("a", 1), ("b", 1), ("c", 2), ("d", 2), ("a", 2))]
    df = spark.createDataFrame(rows, "benchmark string, filter string, model_name string, sample_id long, correct boolean")
    r = coverage.coverage(df).first()
    assert (r["covered"], r["majority"], r["models"] if "models" in r else 4) == (2, 1, 4)


def bits(spark, table):
    return spark.createDataFrame([(o, p, bool(x)) for o, v in enumerate(table) for p, x in enumerate(v)], "ord long, pos int, solved boolean")


def test_hamming_needs_equal_lengths(spark):
    with pytest.raises(Exception, match="length"):
        novelty.hamming(bits(spark, [[1, 0], [1, 0, 1]])).collect()
    assert novelty.hamming(bits(spark, [[1, 0, 1], [0, 0, 1]])).first()["distance"] == 1


def loop_fitter(models):
    """The rule as a loop over the population: the flag rises once a solution has no fitter one."""
    out, found = {}, False
    for o, path, fit in models:
        f = [q for q, p2, f2 in models if (f2 >= fit and p2 != path if found else f2 > fit)]
        if not f and not found:
            found = True
        out[o] = sorted(f)
    return out


def test_fitter_sets_follow_the_loop(spark):
    rng = np.random.default_rng(2)
    for _ in range(4):
        models = [(i, f"m{rng.integers(0, 6)}", float(rng.integers(0, 4))) for i in range(7)]
        got = {i: [] for i in range(7)}
        for r in novelty.fitter(spark.createDataFrame(models, "ord long, model_path string, fitness double")).collect():
            got[r["s"]].append(r["f"])
        assert {k: sorted(v) for k, v in got.items()} == loop_fitter(models)


def test_novelty_without_fitter_is_dominated(spark):
    models = spark.createDataFrame([(0, "a", 2.0), (1, "b", 1.0)], "ord long, model_path string, fitness double")
    got = {r["ord"]: r["novelty"] for r in novelty.novelty(models, bits(spark, [[1, 1, 0], [0, 0, 1]])).collect()}
    assert got == {0: 999.0, 1: 100.0}
    assert {r["novelty"] for r in novelty.novelty(models, bits(spark, [[1, 1, 0], [0, 0, 1]]), k=0).collect()} == {999.0}


def test_greedy_repeats_the_last_pick_and_takes_forced_models_first(spark):
    rows = spark.createDataFrame([(0, "a", 1, 1.0), (1, "b", 2, 1.0), (1, "b", 3, 1.0)], "ord long, model_path string, task_number long, score double")
    got = selection.greedy_cover(rows, 3).orderBy("pick").collect()
    assert [r["model_path"] for r in got] == ["b", "a", "a"]
    got = selection.greedy_cover(rows, 2, include=["a"]).orderBy("pick").collect()
    assert [r["model_path"] for r in got] == ["a", "b"]


def test_optimal_cover_has_no_result_without_cover(spark):
    assert selection.optimal_cover(bits(spark, [[0, 0], [0, 0]]), 2).count() == 0
    with pytest.raises(ValueError, match="subsets"):
        selection.every_subset(spark.range(60).selectExpr("id AS ord", "0 AS pos", "true AS solved"), 12)
    got = selection.optimal_cover(spark.range(60).selectExpr("id AS ord", "0 AS pos", "true AS solved"), 12).first()
    assert (got["members"], got["covered"]) == (list(range(12)), 1)


def test_biased_draw_fills_the_slots_in_order(spark):
    rows = [(i, -1.0 if i == 9 else i / 8) for i in range(10)]
    rated = spark.createDataFrame(rows, "task_number long, rate double").withColumn("difficulty", pool.difficulty(F.col("rate")))
    got = pool.biased_parents(rated, 12, lambda k: draw(k, 1), lambda k: uniform(k, 2), impossible=True).orderBy("slot").collect()
    hows = [r["how"] for r in got]
    assert hows[0] == "impossible" and hows.index("medium") == 1 + hows.count("weighted")
    medium = [r["task_number"] for r in got if r["how"] == "medium"]
    assert len(set(medium)) == len(medium) and 9 not in {r["task_number"] for r in got}


@pytest.mark.parametrize(
    "text,answer",
    [
        ("so \\boxed{4} and \\boxed{5}", "4} and \\boxed{5"),
        ("x #### 7 \n", "7"),
        ("Answer: 8", " 8"),
        ("\\boxed{open\n}", "No answer found."),
        ("nothing", "No answer found."),
    ],
)
def test_extract_answer(spark, text, answer):
    assert one(spark, t.extract_answer(F.col("s")), s=text) == answer


def test_judge_parsers(spark):
    assert one(spark, t.decision_index(F.col("s")), s="DECISION: 3") == 2
    assert one(spark, t.decision_index(F.col("s")), s="DECISION: x") == -1
    assert one(spark, t.decision_score(F.col("s")), s="[[7]]") == 7
    assert one(spark, t.decision_pair(F.col("s")), s="[[C]]") == -1
    assert one(spark, t.decision_last_line(F.col("s")), s="a\ndecision: NO \nb") is False


def test_seed_names_are_prefix_matches(spark):
    assert one(spark, t.is_seed_model(F.col("s")), s="gen_0_ind_3x") is False
    assert one(spark, t.is_seed_model(F.col("s")), s="my_gen_0_ind_3") is True
    assert one(spark, t.is_seed_label(F.col("s")), s="my_gen_0_ind_3") is False


def test_certainty(spark):
    tokens = F.array(F.array(F.struct(F.lit(-1.0).alias("logprob")), F.struct(F.lit(-3.0).alias("logprob"))))
    got = one(spark, answers.self_certainty(tokens), s="x")
    assert abs(got - -(2 * np.log(2) - 4) / 2) < 1e-12
    with pytest.raises(Exception, match="no tokens"):
        one(spark, answers.self_certainty(F.array().cast("array<array<struct<logprob:double>>>")), s="x")


def test_tournament_leaves_one(spark):
    rows = [("b", "f", 1, o, f"m{o}", o == 2) for o in range(5)]
    df = spark.createDataFrame(rows, "benchmark string, filter string, sample_id long, ord long, model_name string, correct boolean")
    pairs = spark.createDataFrame([(1, a, b, 0 if a == 2 else 1 if b == 2 else -1) for a in range(5) for b in range(a + 1, 5)], "sample_id long, a long, b long, winner int")
    got = answers.tournament(df, pairs, draw, 3).collect()
    assert [(r["model_name"], r["correct"]) for r in got] == [("m2", True)]


def test_vendi_score_of_orthogonal_and_equal_vectors(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "gen long, embedding array<double>")
    for q in (1.0, 0.5):
        got = {r["gen"]: r["score"] for r in vectors.gram_entropy(df, "gen", q).collect()}
        assert abs(got[1] - 2) < 1e-4 and abs(got[2] - 1) < 1e-4


def test_diversity_is_that_of_the_similarity_matrix(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("label AS gen", "embedding")
    got = {r["gen"]: r["score"] for r in vectors.gram_entropy(df, "gen", 1.0).collect()}
    for gen, part in df.toPandas().groupby("gen"):
        x = np.stack(part["embedding"].to_numpy()).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        e = np.linalg.eigvalsh(x @ x.T / len(x))
        e = e[e > 1e-12]
        assert abs(got[gen] - np.exp(-(e * np.log(e)).sum())) < 1e-4


def test_failed_embeddings_are_zero(spark):
    def embed(texts):
        if (texts == "bad").any():
            raise ValueError("bad")
        return [[1.0, 2.0] for _ in texts]

    df = spark.createDataFrame([("ok",), ("bad",)], "s string").coalesce(1)
    got = {r["s"]: r["embedding"] for r in vectors.embedded(df, "s", embed, 2).collect()}
    assert got == {"ok": [1.0, 2.0], "bad": [0.0, 0.0]}


def test_dimension_mismatch_on_import(spark):
    a = spark.createDataFrame([("a", [1.0, 2.0])], "sample_id string, embedding array<float>")
    b = spark.createDataFrame([("b", [1.0])], "sample_id string, embedding array<float>")
    with pytest.raises(Exception, match="dimensions"):
        vectors.imported(a, b).collect()
    assert vectors.imported(a, b, overwrite=True).collect() == b.collect()


def test_samples_from_files(spark, tmp_path):
    line = lambda i, f, x: json.dumps({"doc_id": i, "doc": {"question": f"q{i}", "answer": "#### 1"}, "target": "1", "resps": [["r"]], "filtered_resps": ["p"], "filter": f, "exact_match": x})
    for m in ("m1", "m2"):
        (tmp_path / m).mkdir()
        (tmp_path / m / "samples_gsm8k_2025-01.jsonl").write_text("\n".join([line(1, "flexible-extract", 0), line(1, "flexible-extract", 1), line(2, "strict-match", 1)]))
        (tmp_path / m / "samples_gsm8k_llm_as_a_judge_2025.jsonl").write_text(line(9, "flexible-extract", 1))
        (tmp_path / m / "results_1.json").write_text(json.dumps({"results": {"gsm8k": {"exact_match,flexible-extract": 0.5, "alias": "gsm8k"}}}, indent=2))
    rows = harness.read_samples(spark, str(tmp_path), "gsm8k")
    got = harness.normalized(rows, "gsm8k").orderBy("model_name").collect()
    assert [(r["model_name"], r["sample_id"], r["correct"], r["prediction"]) for r in got] == [("m1", "1", True, "p"), ("m2", "1", True, "p")]
    assert harness.read_samples(spark, str(tmp_path), "gsm8k", judge=True).count() == 2
    results = harness.read_results(spark, str(tmp_path))
    assert {r["value"] for r in harness.main_metrics(results, {"gsm8k": "exact_match,flexible-extract"}).collect()} == {0.5}


def test_archives_from_files(spark, tmp_path):
    solution = {"model_path": "gen_0_ind_1", "fitness": 0.5, "own_skill_vector": {"task_10_b": 1.0, "other": 0.0, "task_2_a": 0.5}, "own_eval_details": [{"task_id": str(i)} for i in range(4)]}
    (tmp_path / "gen0_archive.json").write_text(json.dumps([solution]))
    (tmp_path / "gen5_own_archive.json").write_text(json.dumps([solution, solution], indent=2))
    (tmp_path / "active_pool_gen_3.json").write_text(json.dumps(["/p/task_7_x", "/p/seed"]))
    rows = archives.read_archives(spark, str(tmp_path), [5])
    assert rows.count() == 2
    kept = archives.archive_rows(rows, 2).first()
    assert [e["task"] for e in kept["skills"]] == ["task_2_a", "task_10_b", "other"]
    assert [d["task_id"] for d in kept["details"]] == ["2", "3"]
    assert [(r["gen"], r["pos"], r["task_number"]) for r in archives.read_active_pools(spark, str(tmp_path)).orderBy("pos").collect()] == [(3, 0, 7), (3, 1, -1)]


def test_stream_upserts_the_latest_row(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    schema = spark.createDataFrame([], "model_name string, sample_id long, at long, correct boolean").schema
    for k, ok in enumerate((False, True)):
        (source / f"{k}.json").write_text(json.dumps({"model_name": "m", "sample_id": 1, "at": k, "correct": ok}))
        upsert_stream(spark, str(source), schema, target, ["model_name", "sample_id"], "at", str(tmp_path / "cp")).awaitTermination()
    assert [r["correct"] for r in current(spark, target, ["model_name", "sample_id"], "at").collect()] == [True]


def test_empty_population(spark):
    empty = spark.createDataFrame([], "ord long, model_path string, task_number long, score double")
    assert skills.assemble(empty).count() == 0
    assert selection.greedy_cover(empty, 2).count() == 0


def test_ancestry_has_no_limit_of_rows_or_depth(spark):
    from evalspark.operators.evolution import ancestry

    tasks = "task_number long, parent_number long, original_pass_rate double"
    deep = spark.createDataFrame([(i, i - 1 if i else None, i / 100) for i in range(70)], tasks)
    assert {(r["task_number"], r["step"], r["ancestor"], r["rate"]) for r in ancestry(deep).collect()} == {(i, i - j, j, j / 100) for i in range(70) for j in range(i + 1)}
    wide = spark.range(400_000).selectExpr("id AS task_number", "CASE WHEN id >= 4 THEN id % 4 END AS parent_number", "0.5D AS original_pass_rate")
    wide = wide.unionByName(spark.range(400_000, 800_000).selectExpr("id AS task_number", "id - 400000 AS parent_number", "0.5D AS original_pass_rate"))
    assert ancestry(wide).count() == 4 + 2 * 399_996 + 2 * 4 + 3 * 399_996
    ring = spark.createDataFrame([(0, 2, 0.5), (1, 0, 0.5), (2, 1, 0.5)], tasks)
    with pytest.raises(ValueError):
        ancestry(ring)



def vendi(x, q):
    x = np.asarray(x, float)
    x = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)
    e = np.linalg.eigvalsh(x @ x.T / len(x))
    e = e[e > 1e-12]
    return np.exp(-(e * np.log(e)).sum()) if q == 1 else (e**q).sum() ** (1 / (1 - q))


def test_diversity_queries_against_similarity_matrices(spark, sf_dir):
    from evalspark.plans import registry
    from evalspark.plans.views import Views

    registry.load()
    v = Views(spark, sf_dir)
    e = {r["vec_id"]: (r["label"], r["embedding"]) for r in v.embeddings.collect()}
    got = {r["gen"]: r["score"] for r in registry.QUERIES["h09_diversity_per_generation"](spark, sf_dir).collect()}
    labels = {k for k, _ in e.values()}
    assert got.keys() == labels and all(abs(got[k] - vendi([x for n, x in e.values() if n == k], 1)) < 1e-4 for k in labels)
    pools = {(r["gen"], r["task_number"]) for r in v.active_pool.collect()}
    got = {r["gen"]: (r["n"], r["score"]) for r in registry.QUERIES["h10_diversity_cumulative"](spark, sf_dir).collect()}
    for gen in {g for g, _ in pools}:
        x = [e[t][1] for t in {t for g, t in pools if g <= gen} if t in e]
        assert got[gen][0] == len(x) and abs(got[gen][1] - vendi(x, 0.5)) < 1e-4


def test_projection_is_onto_the_main_axes(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows, bounds = vectors.projected(df, 5)
    got = rows.toPandas().sort_values("vec_id")
    x = np.stack(df.toPandas().sort_values("vec_id")["embedding"].to_numpy()).astype(float)
    axes = np.linalg.eigh(np.cov(x.T))[1][:, ::-1][:, :2]
    for k, c in enumerate("xy"):
        want = x @ axes[:, k]
        assert min(np.abs(got[c] - want).max(), np.abs(got[c] + want).max()) < 1e-6
    assert set(got["cluster"]) == set(range(5))
    low, high, pad = got["x"].min(), got["x"].max(), 0.05 * (got["x"].max() - got["x"].min())
    b = bounds.first()
    assert abs(b["x_low"] - low + pad) < 1e-9 and abs(b["x_high"] - high - pad) < 1e-9


def test_scores_are_tried_again(spark, tmp_path):
    def once_broken(batch):
        mark = tmp_path / f"tried-{batch['i'].iloc[0]}"
        if not mark.exists():
            mark.write_text("")
            raise ValueError("busy")
        return batch["i"] * 2

    df = spark.range(5).withColumnRenamed("id", "i").coalesce(1)
    assert {r["i"]: r["scores"]["rm"] for r in answers.attached_scores(df, "rm", once_broken, batch_rows=2).collect()} == {i: 2.0 * i for i in range(5)}
    with pytest.raises(Exception, match="never"):
        answers.attached_scores(df, "rm", lambda b: (_ for _ in ()).throw(ValueError("never"))).collect()


def test_similar_earlier_ones_in_blocks(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4))
    df = spark.createDataFrame([(i * 7, x[i].tolist()) for i in range(300)], "sample_id long, embedding array<double>").repartition(4)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {i * 7 for i in range(300) if (unit[:i] @ unit[i] >= 0.9).any()}
    for ball in (512, 40, 7):
        assert {r["sample_id"] for r in vectors.with_earlier(df, 0.9, balls.Sizes(ball=ball, chunk_bytes=32 * 25)).collect()} == want


def test_baselines_whose_models_are_absent_are_left_out(spark):
    from evalspark.operators import coverage

    names = spark.createDataFrame([(n,) for n in ("a", "b", "Big-70B", "c/1", "c/2")], "model_name string")
    got = {(r["baseline"], r["n"], r["model_name"]) for r in coverage.baselines(names, ["a", "b"], "Big-70B", "c/").collect()}
    assert got == {("experts", 2, "a"), ("experts", 2, "b"), ("big_70B", 1, "Big-70B"), ("control", 1, "c/1"), ("control", 2, "c/1"), ("control", 2, "c/2"), *(("control", n, f"c/{i}") for n in range(3, 9) for i in (1, 2))}
    assert coverage.baselines(names, ["a", "x"], "y-8B", "z").count() == 0


def test_two_fields_with_one_ending_are_an_error(spark, tmp_path):
    (tmp_path / "gen1_archive.json").write_text(json.dumps([{"model_path": "m", "a_skill_vector": {"t": 1.0}, "b_skill_vector": {"t": 0.0}}]))
    with pytest.raises(Exception, match="several fields"):
        archives.read_archives(spark, str(tmp_path)).collect()


def test_task_directories_from_files(spark, tmp_path):
    for name, task, meta in (("task_1_a", {"name_of_task": "a"}, {"generation_type": "initial", "task_number": 1}), ("old", {"name_of_task": "o"}, {"generation_type": "seed"}), ("other", {}, {"generation_type": "initial"}), ("task_2_b", {}, None), ("task_3_c", None, {"task_number": 3})):
        (tmp_path / name).mkdir()
        for file, value in (("task.json", task), ("metadata.json", meta)):
            if value is not None:
                (tmp_path / name / file).write_text(json.dumps(value, indent=1))
    (tmp_path / "task_3_c" / "task.json").write_text("no JSON")
    got = {r["task"]: (r["name_of_task"], r["task_number"]) for r in archives.read_task_dirs(spark, str(tmp_path)).collect()}
    assert got == {"task_1_a": ("a", 1), "old": ("o", None)}
