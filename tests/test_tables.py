import os
import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from evalspark.operators.answers import tournament
from evalspark.operators.balls import Sizes
from evalspark.operators.clusters import components, density_clusters
from evalspark.operators.evolution import ancestry, lineage
from evalspark.operators.selection import greedy_cover
from evalspark.sources.tables import Tables, scratch, scratch_dir

ROOT = Path(__file__).resolve().parents[1]


def held(folder):
    """Names of the tables under a folder, without their numbers."""
    return sorted(p.name.split("-", 1)[1] for p in Path(folder.removeprefix("file:")).glob("tables-*/*"))


def test_scratch_goes_at_the_end(spark):
    before = scratch_dir(spark)
    with scratch(spark) as outer:
        a = Tables(spark).save(spark.range(5), "a")
        with scratch(spark) as inner:
            assert inner.startswith(outer) and Tables(spark).save(spark.range(3), "b").count() == 3
        assert not Path(inner).exists() and a.count() == 5 and held(outer) == ["a"]
    assert not Path(outer).exists() and scratch_dir(spark) == before
    with pytest.raises(KeyError), scratch(spark) as failed:
        Tables(spark).save(spark.range(5), "a")
        raise KeyError
    assert not Path(failed).exists() and scratch_dir(spark) == before
    with scratch(spark):  # nothing was written
        pass


def test_dropped_tables(spark):
    with scratch(spark) as folder:
        tables = Tables(spark)
        a, b = tables.save(spark.range(5), "a"), tables.save(spark.range(5), "b")
        tables.drop(a)
        assert held(folder) == ["b"] and b.count() == 5


def chain(spark, n):
    return spark.range(2, n + 1).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))


def test_components_keep_the_last_round(spark):
    with scratch(spark) as folder:
        found = components(chain(spark, 200))
        assert held(folder) == ["ids", "links"] and found.where("component = 1").count() == 200


def test_lineage_and_ancestry_keep_what_they_found(spark):
    with scratch(spark) as folder:
        edges = chain(spark, 40).select(F.col("a").alias("child"), F.col("b").alias("parent"))
        found = lineage(edges, edges.select("child"))
        assert set(held(folder)) == {"lineage"} and found.count() == 40 * 39 // 2
    with scratch(spark) as folder:
        tasks = spark.range(1, 41).select(F.col("id").alias("task_number"), F.when(F.col("id") > 1, F.col("id") - 1).alias("parent_number"), F.lit(0.5).alias("original_pass_rate"))
        found = ancestry(tasks)
        assert held(folder).count("jumps") == 1 and found.count() == 40 * 41 // 2


def test_picks_and_rounds(spark):
    with scratch(spark) as folder:
        rows = [(m, f"m{m}", t, float(t % (m + 2) == 0)) for m in range(4) for t in range(30)]
        skills = spark.createDataFrame(rows, "ord long, model_path string, task_number long, score double")
        found = greedy_cover(skills, 3)
        assert held(folder) == ["pick"] * 3 and found.count() == 3
    with scratch(spark) as folder:
        rows = [("b", "f", s, m, f"m{m}", m == s % 8) for s in range(5) for m in range(8)]
        candidates = spark.createDataFrame(rows, "benchmark string, filter string, sample_id long, ord long, model_name string, correct boolean")
        pairs = spark.createDataFrame([(s, a, b, 1) for s in range(5) for b in range(8) for a in range(b)], "sample_id long, a long, b long, winner int")
        found = tournament(candidates, pairs, lambda x, k: F.xxhash64(x, F.lit(k)), 3)
        assert held(folder) == ["round"] and {r["model_name"] for r in found.collect()} == {"m7"}


def test_vectors_are_kept_once(spark):
    rows = [(i, [float(i % 5 == k) + 0.001 * (i % 7) for k in range(5)]) for i in range(100)]
    with scratch(spark) as folder:
        found = density_clusters(spark.createDataFrame(rows, "sample_id long, embedding array<double>"), 0.9, sizes=Sizes())
        assert {"vectors", "dealt", "dense", "forest"}.isdisjoint(held(folder))
        assert {r["n"] for r in found.groupBy("cluster").agg(F.count("*").alias("n")).collect()} == {20}


UNSET = """
from pyspark.sql import SparkSession
from evalspark.sources.tables import SETTING, Tables
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert not spark.conf.get(SETTING, None)
a, b = Tables(spark), Tables(spark)
assert a.root.rsplit("/", 1)[0] == b.root.rsplit("/", 1)[0]
print("rows", a.save(spark.range(3), "a").count())
"""


def test_a_local_session_without_the_setting(tmp_path):
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(ROOT), "TMPDIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", UNSET], env=env, capture_output=True, text=True, timeout=120)
    assert "rows 3" in done.stdout, done.stderr[-2000:]


def test_a_cluster_without_the_setting():
    conf = SimpleNamespace(get=lambda *_: None)
    context = SimpleNamespace(getConf=lambda: conf, master="spark://host:7077", applicationId="app")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(SimpleNamespace(conf=conf, sparkContext=context))
