"""JSON arrays by elements, against whole files parsed at once."""

import json
import random
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from evalspark.sources import archives
from evalspark.sources.arrays import read_arrays, read_objects, write_arrays
from evalspark.sources.files import read_texts

BROKEN = ["", " ", "[", "]", "[1, 2", "[1,, 2]", "[1, ]", '{"a": [1, 2]}', '["a, "b"]', '["a", "b]', '[{"a": 1]}', '[1, {"a": 1]', "[1}", "[1 2]", '"[1, 2]"', '[{"a": 1, "a": 2}]']

#: Here the parser of whole files takes the first value and leaves the rest unread.
LONGER = ["[1, 2]]", "[1, 2] 3", "[1], [2]", "[1][2]", "[1]] [[2]"]


@contextmanager
def small_splits(spark, size):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    try:
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "1")
        yield
    finally:
        for n, value in zip(names, before, strict=True):
            spark.conf.set(n, value)


def some_value(rng, depth=0):
    kind = rng.randrange(8 if depth < 3 else 4)
    if kind < 2:
        return "".join(rng.choice(['"', "\\", ",", "[", "]", "{", "}", "a", "é", "漢", "\n", " ", '\\"', ",,"]) for _ in range(rng.randrange(12)))
    if kind < 4:
        return rng.choice([None, True, 0, -3, 2.5])
    if kind < 6:
        return [some_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {f"{i}{rng.choice(',]')}": some_value(rng, depth + 1) for i in range(rng.randrange(4))}


def elements(spark, root, name):
    found = {}
    for r in read_arrays(spark, str(root), name).collect():
        found.setdefault(r["file_name"], []).append((r["ord"], json.loads(r["value"])))
    return {k: sorted(v, key=lambda x: x[0]) for k, v in found.items()}


@pytest.mark.parametrize("size", [7, 64, 1 << 20])
def test_elements_are_those_of_the_whole_file(spark, tmp_path, size):
    rng = random.Random(size)
    arrays = {f"x{i}.json": [some_value(rng) for _ in range(rng.randrange(30))] for i in range(6)}
    for i, (name, value) in enumerate(arrays.items()):
        text = json.dumps(value, indent=[None, 2][i % 2], ensure_ascii=i % 3 > 0)
        (tmp_path / name).write_text("﻿" * (i == 4) + text + "\n" * (i % 2), encoding="utf-8")
    (tmp_path / "other.json").write_text("[1]")
    with small_splits(spark, size):
        assert elements(spark, tmp_path, r"^x\d") == {name: list(enumerate(value)) for name, value in arrays.items() if value}


def test_broken_files_have_no_elements_and_harm_no_others(spark, tmp_path):
    for i, text in enumerate([*BROKEN, "[]", " [ \n ] "]):
        (tmp_path / f"x{i}.json").write_text(text)
    (tmp_path / "good.json").write_text("[1, 2]")
    plain = read_texts(spark, str(tmp_path), "json$", whole=True)
    plain = plain.select("file_name", F.explode(F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>")))
    assert {r["file_name"] for r in plain.collect()} == {"good.json"}
    for i, text in enumerate(LONGER):
        (tmp_path / f"y{i}.json").write_text(text)
    for size in (3, 1 << 20):
        with small_splits(spark, size):
            assert elements(spark, tmp_path, "json$") == {"good.json": [(0, 1), (1, 2)]}


def test_no_files(spark, tmp_path):
    (tmp_path / "other.json").write_text("[1]")
    assert read_arrays(spark, str(tmp_path), "^x").count() == 0


def test_one_long_array_over_many_splits(spark, tmp_path):
    """As the whole file read at once, by many tasks, and no row of the tables on the way is longer than an element."""
    paths = [f"/pool/task_{i}_a,b]\"{i}/" for i in range(3000)]
    (tmp_path / "active_pool_gen_4.json").write_text(json.dumps(paths))
    with small_splits(spark, 5000):
        pool = archives.read_active_pools(spark, str(tmp_path))
        got = [tuple(r) for r in pool.select("gen", "pos", "task").orderBy("pos").collect()]
        assert read_arrays(spark, str(tmp_path), "json$").agg(F.max(F.length("value"))).first()[0] < 60
    assert got == [(4, i, p.split("/")[2]) for i, p in enumerate(paths)]


def test_written_in_order_and_read_again(spark, tmp_path):
    rows = spark.range(500).select(
        (F.col("id") % 3).cast("string").alias("folder"),
        F.concat(F.lit("a"), (F.col("id") % 2).cast("string"), F.lit(".json")).alias("name"),
        (500 - F.col("id")).alias("n"),
        F.to_json(F.struct("id", F.lit('q",[').alias("s"))).alias("value"),
    )
    path = str(tmp_path / "out")
    write_arrays(rows.repartition(7), path, "n")
    with small_splits(spark, 200):
        back = read_arrays(spark, path, "json$").select("folder", "file_name", "ord", F.get_json_object("value", "$.id").cast("int").alias("id"))
    got = {}
    for r in back.orderBy("ord").collect():
        got.setdefault((r["folder"], r["file_name"]), []).append(r["id"])
    assert got == {(str(f), f"a{k}.json"): [i for i in range(499, -1, -1) if i % 3 == f and i % 2 == k] for f in range(3) for k in range(2)}
    texts = [json.loads(r["value"]) for r in read_texts(spark, path, "json$", whole=True).collect()]
    assert sum(map(len, texts)) == 500


def test_equal_places_make_one_array(spark, tmp_path):
    path = str(tmp_path / "out")
    write_arrays(spark.range(50).select(F.lit("f").alias("folder"), F.lit("a.json").alias("name"), F.lit(0).alias("n"), F.col("id").cast("string").alias("value")), path, "n")
    assert sorted(r["value"] for r in read_arrays(spark, path, "json$").collect()) == sorted(map(str, range(50)))


def test_members_of_long_objects_are_rows(spark, tmp_path):
    """Members of a field's objects as rows, however files are split, and no element holds them; broken files have none."""
    odd = lambda j: f"task_{j}_x" + ('"é,{' if j % 17 == 0 else "\\" if j % 13 == 0 else "")
    objects = [{"m": f'x{i},"[{{', "a_skills": {odd(j): j / 7 for j in range(i * 40)}, "other": {f"k{j}": j for j in range(9)}, "d": [{"a": [1, {"z": {"q": 1, "r": 2, "s": 3}}]}], "v": [1, 2, 3, 4]} for i in range(4)]
    text = json.dumps(objects)
    (tmp_path / "a.json").write_text(text)
    (tmp_path / "b.json").write_text("﻿" + json.dumps(objects[::-1], indent=1, ensure_ascii=False), encoding="utf-8")
    for i, wrong in enumerate([text[:-1], text + "]", text.replace('"task_5_x": ', '"task_5_x" '), text.replace('"task_13_x\\\\": ', '"task_13_x\\": '), *BROKEN, *LONGER]):
        (tmp_path / f"c{i}.json").write_text(wrong)
    (tmp_path / "d.json").write_text("[1, 2]")
    for size in (2000, 1 << 20):
        with small_splits(spark, size):
            elements, members = read_objects(spark, str(tmp_path), r"json$", "_skills")
            found, got = {}, {}
            for r in elements.collect():
                found.setdefault(r["file_name"], {})[r["ord"]] = r["value"]
            for r in members.collect():
                got.setdefault((r["file_name"], r["ord"]), []).append((r["key"], r["number"]))
        assert found.keys() == {"a.json", "b.json", "d.json"} and found["d.json"] == {0: "1", 1: "2"}
        for name, want in (("a.json", objects), ("b.json", objects[::-1])):
            for i, x in enumerate(want):
                kept = json.loads(found[name][i])
                assert {**kept, "a_skills": x["a_skills"]} == x and len(kept["a_skills"]) < 20
                assert sorted(got.pop((name, i), [])) == sorted(x["a_skills"].items())
        assert not got


def test_texts_of_skills_in_order(spark):
    names = [f"task_{i * 7919 % 30011}_x" for i in range(30000)] + ["other", "another"]
    rows = spark.createDataFrame([(g, 1, n, 0.5) for g in (0, 2) for n in names[g:]], "gen long, ord long, task string, score double")
    got = {r["gen"]: r["text"].split(",") for r in archives.skill_texts(rows, F.col("task")).collect()}
    number = lambda n: int(n.split("_")[1]) if "_" in n else 1 << 62
    assert got == {g: sorted(names[g:], key=lambda n: (number(n), n)) for g in (0, 2)}
    assert archives.skill_texts(rows.limit(0), F.col("task")).count() == 0
