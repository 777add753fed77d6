"""Steps whose cost has to grow no faster than their input: each on a small case that the earlier form could not do."""

import io
from contextlib import redirect_stdout
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evalspark.functions.hashing import draw
from evalspark.operators import answers, balls, coverage, order, pool, questions, vectors
from evalspark.plans import views
from evalspark.sources import archives, files, harness
from evalspark.sources.files import read_texts, write_lines, write_named, write_packed
from evalspark.sources.tables import scratch


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("simple")
    return out.getvalue()


def test_merged_evaluations_of_many_tasks(spark):
    """100,000 tasks of one model, every second one evaluated again: as maps, each key was sought among all others."""
    n = 100_000
    scores = spark.range(n).select(F.lit(1).alias("ord"), F.col("id").alias("task_number"), F.lit(1.0).alias("score"))
    details = spark.createDataFrame([(1, "a"), (2, "b")], "ord int, task_id string")
    again = scores.where("task_number % 2 = 0").withColumn("score", F.lit(3.0))
    again = again.unionByName(again.limit(5).withColumn("ord", F.lit(9)))
    new = spark.createDataFrame([(1, "c"), (9, "d")], "ord int, task_id string")
    merged, shown, models = pool.merged_evaluations(scores, details, again, new)
    assert {tuple(r) for r in models.collect()} == {(1, n, 2.0 * n, 2.0), (2, 0, 0.0, 0.0)}
    assert {tuple(r) for r in shown.collect()} == {(1, "a", 0), (2, "b", 0), (1, "c", 1)}
    assert merged.count() == n and merged.where("task_number = 4 and score = 3").count() == 1


def test_hashed_embedding_reads_its_text_once(spark):
    rows = spark.createDataFrame([(0, "One two  two three\n"), (1, " "), (2, "x " * 50 + "y")], "id long, t string")
    got = rows.select("id", vectors.hashed_embedding(F.col("t"), 4).alias("e"))
    assert plan(got).count("split(") == 1
    word = F.explode(F.split(F.lower("t"), r"\s+")).alias("w")
    slots = rows.select("id", word).where("w <> ''").select("id", F.pmod(F.xxhash64("w"), F.lit(4)).alias("at"), (1 - 2 * F.pmod(F.xxhash64("w", F.lit(1)), F.lit(2))).alias("sign"))
    want = np.zeros((3, 4))
    for r in slots.collect():
        want[r["id"], r["at"]] += r["sign"]
    norm = np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose([r["e"] for r in got.orderBy("id").collect()], np.divide(want, norm, out=np.zeros_like(want), where=norm > 0))


def test_question_store_sorts_once(spark, tmp_path):
    rows = spark.createDataFrame([("s", i, "text" if i % 4 else "") for i in range(20)], "subgroup string, idx long, content string").withColumn("metadata", F.create_map(F.lit("k"), F.lit("v")))
    with scratch(spark) as folder:
        stored, report = questions.question_store({"b one": rows.where("idx < 10"), "c": rows.where("idx >= 10")})
        assert {r["question_id"] for r in stored.collect()} == {*(f"b_one_s_{i}" for i in range(10) if i % 4), *(f"c_s_{i - 10}" for i in range(10, 20) if i % 4)}
        assert {tuple(r) for r in report.collect()} == {("b one", 7, 3), ("c", 8, 2)}
        assert len(list(Path(folder).glob("tables-*/*-ranges"))) == 1


def test_similarity_pairs_by_blocks(spark):
    """Blocks of any size give the pairs of a plain join, with repeated ids, nulls and other lengths; no key is too large."""
    r = np.random.default_rng(3)
    rows = [(i % 60, "ab"[i % 7 > 4], [float(x) for x in r.normal(size=3)]) for i in range(70)]
    rows += [(90, "a", None), (91, "a", [1.0, None, 2.0]), (92, "b", [1.0, 2.0]), (93, "b", [2.0, 2.0]), (94, "b", [0.0] * 3), (None, "a", [1.0] * 3), (95, None, [1.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, k string, embedding array<float>")
    unit = df.withColumn("u", F.transform("embedding", lambda x: x.cast("double") / (F.sqrt(vectors.dot(F.col("embedding"), F.col("embedding"))) + F.lit(1e-8))))
    a, b = (unit.select("k", F.col("vec_id").alias(c), F.col("u").alias(f"u{c}")) for c in "ab")
    shown = lambda rows: sorted(((r["k"], r["a"], r["b"], None if r["similarity"] is None else round(r["similarity"], 9) + 0.0) for r in rows.collect()), key=str)
    want = shown(a.join(b, "k").where("a <= b").select("k", "a", "b", vectors.dot(F.col("ua"), F.col("ub")).alias("similarity")))
    for block in (4, 1000):
        assert shown(vectors.similarity_pairs(df, "k", block=block)) == want
    large = spark.range(20_100).select(F.col("id").alias("vec_id"), F.lit(1).alias("k"), F.array(F.lit(1.0)).alias("embedding"))
    assert vectors.similarity_pairs(large, "k").count() == 20_100 * 20_101 // 2


def test_packed_task_directories(spark, tmp_path):
    """A pack has the rows of the directories it holds, in a few files."""
    files = [(f"task_{i}_x", "task.json", f'{{"name_of_task": "n {i}\\n"}}') for i in range(30)]
    files += [(f"task_{i}_x", "metadata.json", f'{{"task_number": {i}}}') for i in range(0, 30, 2)] + [("task_40_x", "task.json", "no JSON"), ("task_40_x", "metadata.json", "{}"), ("task_0_x", "other.json", "{}")]
    rows = spark.createDataFrame(files, "folder string, name string, value string").coalesce(2)
    write_named(rows, f"{tmp_path}/loose")
    write_packed(rows, f"{tmp_path}/pack")
    got, want = (sorted(map(tuple, archives.read_task_dirs(spark, f"{tmp_path}/{p}", packed=p == "pack").collect())) for p in ("pack", "loose"))
    assert got == want and len(got) == 15
    assert len(list(Path(f"{tmp_path}/pack").glob("*.parquet"))) <= 2


def test_routed_queries_go_in_small_batches(spark, monkeypatch):
    """Queries that reach every ball leave in batches of a bounded number of rows, and none is lost."""
    r = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, [float(x) for x in r.normal(size=4)]) for i in range(300)], "id long, embedding array<double>")
    index = balls.indexed(rows, "id", balls.Sizes(ball=10))
    asks = index.points.select(F.col("id").alias("ask"), "vec").coalesce(1)
    sent = []
    monkeypatch.setattr(type(asks), "mapInArrow", lambda self, run, schema: (sent.extend(run(iter(self.toArrow().combine_chunks().to_batches()))), spark.createDataFrame([], schema))[1])
    balls.routed(index, asks, lambda c, u: np.full(len(u), -1.0))
    assert max(b.num_rows for b in sent) <= balls.SENT
    reached = index.centres.value.radius >= 0
    assert sum(b.num_rows for b in sent) == 300 * reached[:-1].sum() + 300 * reached[-1]


def test_tournament_judges_the_pairs_that_meet(spark):
    """A judge as a function gives what a table of all pairs gives, and takes one shuffle for all rounds."""
    rows = [(b, "f", s, o, f"m{o}", o % 3 == 0) for b in "xy" for s in range(40) for o in range(s % 9 + 1)]
    df = spark.createDataFrame(rows, "benchmark string, filter string, sample_id long, ord long, model_name string, correct boolean")
    winner = (F.col("sample_id") * 7 + F.col("a") * 3 + F.col("b")) % 4 - 1
    places = spark.range(9)
    table = spark.range(40).select(F.col("id").alias("sample_id")).join(places.withColumnRenamed("id", "a")).join(places.withColumnRenamed("id", "b")).where("a < b").withColumn("winner", winner)
    asked = answers.tournament(df, lambda met: met.withColumn("winner", F.when(F.col("a") < F.col("b"), winner)), draw, 4)
    assert sorted(map(tuple, asked.collect())) == sorted(map(tuple, answers.tournament(df, table, draw, 4).collect()))
    assert asked.count() == 80 and plan(asked).split("Initial Plan")[-1].count("Exchange") == 1


def test_scores_of_small_batches_leave_as_one(spark, monkeypatch):
    """A batch function sees at most 64 rows; what it gives leaves in the batches that came."""
    df, sent = spark.createDataFrame([(i,) for i in range(1000)], "id long"), []
    frame = pd.DataFrame({"id": range(1000)})
    monkeypatch.setattr(type(df), "mapInPandas", lambda self, run, schema: (sent.extend(run(iter([frame, frame[:0]]))), spark.createDataFrame([], schema))[1])
    sizes = []
    answers.attached_scores(df, "rm", lambda part: (sizes.append(len(part)), part["id"] % 7)[1])
    assert max(sizes) == 64 and len(sent) == 1 and (sent[0]["new_score"] == frame["id"] % 7).all()


def test_lines_are_parsed_once(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "samples_gsm8k_2025.jsonl").write_text('{"doc_id": 1, "filter": "flexible-extract", "exact_match": 1}\nno JSON\n')
    rows = harness.normalized(harness.read_samples(spark, str(tmp_path), "gsm8k"), "gsm8k")
    assert "Generate explode" in plan(rows)
    assert [(r["sample_id"], r["correct"]) for r in rows.collect()] == [("1", True)]


def test_embedding_sees_few_texts_at_a_time(spark):
    def embed(texts):
        if len(texts) > 300 or "bad" in set(texts):
            raise ValueError
        return [[float(len(t)), 1.0] for t in texts]

    rows = spark.range(2000).coalesce(1).select("id", F.when(F.col("id") == 7, "bad").otherwise(F.repeat(F.lit("x"), (F.col("id") % 9).cast("int"))).alias("t"))
    got = vectors.embedded(rows, "t", embed, 2).orderBy("id").collect()
    assert [(list(r["embedding"]), r["failed"]) for r in got] == [([0.0, 0.0], True) if i == 7 else ([float(i % 9), 1.0], False) for i in range(2000)]


def test_archives_written_by_rows(spark, tmp_path):
    """Skills as rows give what a map gives, in order of their numbers and with any names; no row holds a solution's skills."""
    names = [f"task_{i}_x" for i in range(40)] + ['a "b", {c}', "z\\", "line\nend}"]
    each = spark.createDataFrame([(g, o, n, float(len(n) + o) / 7) for g in (0, 1) for o in (0, 1, 2) for n in names[o:]], "gen long, ord long, task string, score double")
    details = spark.createDataFrame([([("1", "i", "}{,", 0.5), ("2", "i", "r", 1.0)],)], f"details {archives.DETAILS}")
    models = each.select("gen", "ord", F.concat(F.lit("m"), "ord").alias("model_path")).distinct().crossJoin(details)
    maps = each.groupBy("gen", "ord").agg(F.map_from_entries(F.collect_list(F.struct("task", "score"))).alias("skills"))
    archives.write_archives(models.join(maps, ["gen", "ord"]), f"{tmp_path}/maps", max_details=1)
    archives.write_archives(models, f"{tmp_path}/rows", max_details=1, skills=each)
    shown = lambda p: sorted((r.asDict(True) for r in archives.archive_rows(archives.read_archives(spark, f"{tmp_path}/{p}")).collect()), key=lambda r: (r["gen"], r["ord"]))
    assert shown("rows") == shown("maps") and [len(r["skills"]) for r in shown("rows")] == [43, 42, 41] * 2
    text = next(Path(f"{tmp_path}/rows").rglob("name=gen0*/part-*")).read_text()
    assert len(text.splitlines()) == 43 + 42 + 41 + 6 and text.index("task_2_x") < text.index("task_10_x")
    archives.write_archives(models, f"{tmp_path}/none", skills=each.where("ord = 1"))
    assert [len(r["skills"] or []) for r in shown("none")] == [0, 42, 0] * 2
    with pytest.raises(Exception, match="without an element"):
        archives.write_archives(models.where("ord > 0"), f"{tmp_path}/lost", skills=each)


def test_samples_are_dealt_out_once_by_sample(spark, sf_dir, monkeypatch):
    """Tasks grow in number with the table, and all groupings by sample lie in the one that a sample was dealt to."""
    v = views.Views(spark, sf_dir)
    monkeypatch.setattr(views, "DEALT_ROWS", 100)
    assert v.samples_by_sample.rdd.getNumPartitions() == -(-v.lineitem.count() // 100)
    assert sorted(map(tuple, v.samples_by_sample.collect())) == sorted(map(tuple, v.samples.collect()))
    shuffles = plan(coverage.per_sample(v.samples_by_sample)).split("Initial Plan")[-1]
    assert shuffles.count("Exchange") == 1 and "partial_max" in shuffles.split("Exchange")[0]
    shuffles = plan(coverage.score_matrix(v.samples_by_sample, v.samples.where("ord < 4"))).split("Initial Plan")[-1]
    assert shuffles.count("Exchange") == 1 and "Join" not in shuffles


def test_score_matrix_of_absent_rows(spark):
    """Absent rows, null verdicts and null keys are not solved; names that no sample has are columns of the grid too."""
    rows = [("b", "f", 1, "m1", True), ("b", "f", 1, "m9", True), ("b", "f", 2, "m2", None), (None, "f", 3, "m1", True), ("b", "f", 4, "m9", True)]
    df = spark.createDataFrame(rows, "benchmark string, filter string, sample_id long, model_name string, correct boolean")
    chosen = spark.createDataFrame([("m1",), ("m2",), ("m3",)], "model_name string")
    got = {tuple(r) for r in coverage.score_matrix(df, chosen).collect()}
    assert got == {(b, "f", s, m, (s, m) == (1, "m1")) for b, s in (("b", 1), ("b", 2), (None, 3), ("b", 4)) for m in ("m1", "m2", "m3")}
    assert coverage.score_matrix(df, chosen.limit(0)).count() == 0


def test_contributions_group_samples_once(spark):
    """Totals of a key come from the rows of its models, not from a second pass over the samples; a null key has rows too."""
    rows = [("b", "f", 1, "m1", True), ("b", "f", 1, "m2", True), ("b", "f", 2, "m1", True), ("b", "f", 3, "m1", False), (None, "f", 1, "m1", True)]
    df = spark.createDataFrame(rows, "benchmark string, filter string, sample_id long, model_name string, correct boolean")
    got = coverage.contributions(df)
    assert plan(got).split("Initial Plan")[-1].count("Scan") == 1
    assert {tuple(r) for r in got.select("benchmark", "model_name", "contribution", "unique_contribution", "num_samples", "covered").collect()} == {("b", "m1", 2, 1, 3, 2), ("b", "m2", 1, 0, 3, 2), (None, "m1", 1, 1, 1, 1)}


def test_lines_are_written_in_compressed_parts(spark, tmp_path, monkeypatch):
    """Lines of a name lie in compressed parts of bounded size, and are read in order; only the columns of rows are sorted."""
    monkeypatch.setattr(files, "PART_LINES", 300)
    rows = spark.range(4000).select((F.col("id") % 2).cast("string").alias("folder"), F.lit("samples_gsm8k_2025.jsonl").alias("name"), F.col("id").alias("n"))
    line = F.to_json(F.struct(F.col("n").alias("doc_id"), F.lit("flexible-extract").alias("filter"), F.repeat(F.lit("text "), 20).alias("text")))
    write_lines(rows, f"{tmp_path}/out", line, draw(F.col("n"), 3), F.col("n"))
    parts = [p for p in tmp_path.rglob("part-*")]
    assert len(parts) == 2 * -(-2000 // 300) and {p.suffix for p in parts} == {".gz"} and sum(p.stat().st_size for p in parts) < 4000 * 100 / 4
    text = read_texts(spark, f"{tmp_path}/out", "samples").withColumn("n", F.get_json_object("value", "$.doc_id").cast("long"))
    got = {(r["folder"], r["place"]): r["n"] for r in order.placed(text, ["line"], "place", ["folder"], start=0).collect()}
    want = sorted(range(4000), key=lambda n: ((((n * 48271 + 11 + 3 * 7919) % 2147483647) * 48271 + 11) % 2147483647, n))
    assert got == {(str(k), i): n for k in (0, 1) for i, n in enumerate(x for x in want if x % 2 == k)}


def test_population_keeps_what_goes_on(spark, tmp_path):
    """Places without a sort of lines as they are read, and no table on the way holds the lines; dealt out anew, they are sorted."""
    (tmp_path / "in" / "m").mkdir(parents=True)
    (tmp_path / "in" / "m" / "samples_gsm8k_2025.jsonl").write_text("".join(f'{{"doc_id": {i}, "filter": "{"xy"[i % 3 > 0]}"}}\n' for i in range(200)))
    with scratch(spark) as folder:
        rows = harness.read_samples(spark, f"{tmp_path}/in", "gsm8k").withColumn("n", F.try_variant_get("v", "$.doc_id", "int"))
        found = harness.filtered_population(rows, "x", ["n"])
        assert sorted(map(tuple, found.collect())) == [(i, i // 3) for i in range(0, 200, 3)]
        saved = {p.name[4:]: spark.read.parquet(str(p)).columns for p in Path(folder).glob("tables-*/*")}
        assert "v" not in saved["population"] and "ranges" not in saved
        again = harness.filtered_population(rows.repartition(5, "n").sortWithinPartitions(F.desc("n")), "x", ["n"])
        assert sorted(map(tuple, again.collect())) == [(i, i // 3) for i in range(0, 200, 3)]
