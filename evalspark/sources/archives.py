"""Archives, skill vector files, pool snapshots, task directories and parent mappings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.functions.text import generation, task_number
from evalspark.sources.arrays import read_arrays, read_objects, write_arrays
from evalspark.sources.files import read_packed, read_texts

DETAILS = "array<struct<task_id:string,instructions:string,raw_output:string,score:double>>"
ARCHIVE_SCHEMA = f"model_path string, fitness double, skills map<string,double>, skill_vector array<boolean>, details {DETAILS}, validation_quality double, is_gibberish boolean, rank int"


def read_archives(spark: SparkSession, root: str, gens: list[int] | None = None) -> DataFrame:
    """Solutions of ``gen<N>_...archive.json`` (an array each) with gen and ord (place in the array), of the generations
    asked for; files of others are not cut up. A solution is one row, an archive never. A project's prefix of the skill
    map (``..._skill_vector``) and of the details (``..._eval_details``) may be any."""
    pattern = archive_name(gens)
    return solutions(read_arrays(spark, root, pattern), pattern)


def read_archive_rows(spark: SparkSession, root: str, gens: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(solutions as ``read_archives`` gives them, with ``has_skills`` in place of the map; skills: gen, ord, task, score), for
    solutions of any number of skills: no row holds a solution's skills."""
    pattern = archive_name(gens)
    elements, entries = read_objects(spark, root, pattern, "_skill_vector")
    rows = solutions(elements, pattern).withColumn("skills", F.col("skills").isNotNull()).withColumnRenamed("skills", "has_skills")
    return rows, entries.select(generation_of(pattern), "ord", F.col("key").alias("task"), F.col("number").alias("score"))


def archive_name(gens: list[int] | None) -> str:
    number = r"\d+" if gens is None else f"0*(?:{'|'.join(map(str, gens)) or '(?!)'})"
    return rf"^gen({number})_(?:\w+_)?archive\.json$"


def generation_of(pattern: str) -> Column:
    return F.regexp_extract("file_name", pattern, 1).cast("bigint").alias("gen")


def solutions(elements: DataFrame, pattern: str) -> DataFrame:
    each = elements.select(generation_of(pattern), "ord", F.try_parse_json("value").alias("v"))
    each = each.withColumn("m", F.try_variant_get("v", "$", "map<string,variant>"))

    def some(end: str) -> Column:
        found = F.map_values(F.map_filter("m", lambda k, x: F.endswith(k, F.lit(end))))
        return F.when(F.size(found) <= 1, F.get(found, F.lit(0))).otherwise(F.raise_error(F.lit(f"several fields end in {end}")).cast("variant"))

    plain = {"model_path": "string", "fitness": "double", "skill_vector": "array<boolean>", "validation_quality": "double", "is_gibberish": "boolean", "rank": "int"}
    return each.select(
        "gen",
        "ord",
        *(F.try_variant_get("v", f"$.{c}", kind).alias(c) for c, kind in plain.items()),
        F.try_variant_get(some("_skill_vector"), "$", "map<string,double>").alias("skills"),
        F.try_variant_get(some("_eval_details"), "$", DETAILS).alias("details"),
    )


def skill_texts(skills: DataFrame, text: Column, sep: str = ",") -> DataFrame:
    """gen, ord, text: the texts of a solution's skills by task number (names without one last), as one string.

    Skills are sorted over ranges and put together where they lie, some thousands at a time; what comes to one task for
    a solution is these pieces, not its skills.
    """
    order = ["gen", "ord", number(F.col("task")), "task"]
    rows = skills.orderBy(*order).select("gen", "ord", F.monotonically_increasing_id().alias("at"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gen, ord_ = batch.column("gen").to_numpy(), batch.column("ord").to_numpy()
            first = np.r_[0, np.flatnonzero((np.diff(gen) != 0) | (np.diff(ord_) != 0)) + 1]
            lists = pa.ListArray.from_arrays(pa.array(np.r_[first, batch.num_rows], pa.int32()), batch.column("text"))
            if batch.num_rows:
                at = batch.select(["gen", "ord", "at"]).take(pa.array(first))
                yield pa.RecordBatch.from_arrays([*at.columns, pc.binary_join(lists, sep)], names=["gen", "ord", "at", "text"])

    pieces = rows.mapInArrow(run, "gen long, ord long, at long, text string")
    whole = F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda x: x["text"])
    return pieces.groupBy("gen", "ord").agg(F.array_join(whole, sep).alias("text"))


def archive_rows(archive: DataFrame, max_details: int = -1) -> DataFrame:
    """What a saved archive holds: the skill map as entries by task number (names without one last), and the last
    ``max_details`` details where there are more (all if negative; null if there are none)."""
    numbered = F.transform(F.map_entries("skills"), lambda e: F.struct(number(e["key"]).alias("n"), e["key"].alias("key"), e["value"].alias("value")))
    entries = F.transform(F.sort_array(numbered), lambda e: F.struct(e["key"].alias("task"), e["value"].alias("score")))
    return archive.withColumns({"skills": entries, "details": last_details(max_details)})


def number(task: Column) -> Column:
    """Number in a task's name; names without one come last."""
    return F.coalesce(F.regexp_extract(task, r"task_(\d+)_", 1).try_cast("bigint"), F.lit(1 << 62))


def last_details(max_details: int) -> Column:
    details = F.col("details")
    if max_details >= 0:
        last = F.slice(details, -max_details, max_details) if max_details else F.slice(details, 1, 0)
        details = F.when(F.size(details) > max_details, last).otherwise(details)
    return F.when(F.size(details) > 0, details)


def write_archives(archive: DataFrame, root: str, prefix: str = "own", max_details: int = -1, skills: DataFrame | None = None) -> None:
    """A file ``gen<N>_archive.json`` per generation, which ``read_archives`` reads: an array of solutions in order,
    each on its line.

    ``archive``: gen, ord, model_path and any of fitness, skills, skill_vector, details, validation_quality, is_gibberish
    and rank. Skills are written by task number, and the last ``max_details`` details. ``skills``: in place of that
    column, rows of gen, ord, task and score, each task once; so they are sorted and written by rows, however many a
    solution has. Every solution then has the field.
    """
    have = [c for c in ("fitness", "skill_vector", "validation_quality", "is_gibberish", "rank") if c in archive.columns]
    rows = archive if "details" in archive.columns else archive.withColumn("details", F.lit(None).cast(DETAILS))
    named, vector = [], f"{prefix}_skill_vector"
    if skills is not None:
        rows = rows.withColumn("details", last_details(max_details))
        named = [F.col("details").alias(f"{prefix}_eval_details")]
    elif "skills" in archive.columns:
        rows = archive_rows(rows, max_details)
        named = [F.map_from_entries(F.transform("skills", lambda e: F.struct(e["task"].alias("key"), e["score"].alias("value")))).alias(vector), F.col("details").alias(f"{prefix}_eval_details")]
    keys = [F.lit("archives").alias("folder"), F.concat(F.lit("gen"), F.col("gen").cast("string"), F.lit("_archive.json")).alias("name"), "ord"]
    rows = rows.select(*keys, F.to_json(F.struct("model_path", *have, *named)).alias("value"))
    if skills is None:
        return write_arrays(rows, root, "ord")
    entry = F.regexp_extract(F.to_json(F.create_map("task", F.col("score").cast("double"))), r"(?s)^\{(.*)\}$", 1)
    write_arrays(rows, root, "ord", field=vector, entries=skills.select(*keys, number(F.col("task")).alias("n"), "task", entry.alias("value")), within=["n", "task"])


def read_skill_vectors(spark: SparkSession, root: str) -> DataFrame:
    """model_path, gen (second token of its name), task, score of ``<model>_skill_vector.json`` files."""
    rows = read_texts(spark, root, r"_skill_vector\.json$", whole=True)
    name = F.regexp_extract("file_name", r"^(.+)_skill_vector\.json$", 1)
    flat = rows.select(name.alias("model_path"), F.explode(F.from_json("value", "map<string,double>")).alias("task", "score"))
    return flat.withColumn("gen", F.get(F.split("model_path", "_"), F.lit(1)).try_cast("bigint"))


def model_fitness(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("model_path", "gen").agg(F.avg("score").alias("fitness"), F.count("*").alias("n_skills"))


def read_active_pools(spark: SparkSession, root: str) -> DataFrame:
    """gen, pos, task (last part of the path), task_number of ``active_pool_gen_<N>.json`` (arrays of paths)."""
    rows = read_arrays(spark, root, r"^active_pool_gen_\d+\.json$")
    gen = F.regexp_extract("file_name", r"(\d+)\.json$", 1).try_cast("bigint")
    flat = rows.select(gen.alias("gen"), F.col("ord").cast("int").alias("pos"), F.try_variant_get(F.try_parse_json("value"), "$", "string").alias("path"))
    task = F.substring_index(F.rtrim("path", F.lit("/")), "/", -1)
    return flat.select("gen", "pos", task.alias("task"), task_number(task).alias("task_number"))


TASK_SCHEMA = "name_of_task string, description_of_task string, capability_being_measured string, estimated_human_difficulty string, example_instruction string"
META_SCHEMA = "generated_from_task string, generated_from_seed string, generation_type string, original_pass_rate double, task_number long"


def read_task_dirs(spark: SparkSession, root: str, packed: bool = False) -> DataFrame:
    """task.json and metadata.json of each task directory, joined; both are needed, and a task_ name unless it is a seed.
    A file that is no JSON object is missing. ``packed``: the directories are in a pack, with a row per file."""
    pattern = r"^(task|metadata)\.json$"
    rows = read_packed(spark, root, pattern) if packed else read_texts(spark, root, pattern, whole=True)
    text, metadata = (F.max(F.when(F.col("file_name") == name, F.col("value"))) for name in ("task.json", "metadata.json"))
    per = rows.groupBy(F.col("folder").alias("task")).agg(text.alias("text"), metadata.alias("metadata"))
    there = F.try_parse_json("text").isNotNull() & F.try_parse_json("metadata").isNotNull()
    both = per.where(there).select("task", F.from_json("text", TASK_SCHEMA).alias("x"), F.from_json("metadata", META_SCHEMA).alias("y")).select("task", "x.*", "y.*")
    return both.where(F.startswith("task", F.lit("task_")) | (F.col("generation_type") == "seed"))


def synthetic_tasks(tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tasks with an example instruction, missing texts empty; loaded and failed counts)."""
    texts = ["name_of_task", "description_of_task", "capability_being_measured", "estimated_human_difficulty"]
    ok = F.coalesce(F.length("example_instruction") > 0, F.lit(False))
    return tasks.where(ok).fillna("", texts), tasks.agg(F.count_if(ok).alias("loaded"), F.count_if(~ok).alias("failed"))


def parent_mapping(edges: DataFrame, archives: DataFrame) -> DataFrame:
    """child, parent, parent_fitness of models in any archive.

    The fitness is that of the archive one generation before the child's; for generation 0 the parent is a seed, named
    gen_0_ind_<seed> in archive 0.
    """
    known = edges.join(archives.select(F.col("model_path").alias("child")), "child", "left_semi").withColumn("gen", generation(F.col("child")))
    look = F.when(F.col("gen") == 0, F.concat(F.lit("gen_0_ind_"), "parent")).otherwise(F.col("parent"))
    keyed = known.withColumns({"look": look, "at": F.greatest(F.col("gen") - 1, F.lit(0))})
    fit = archives.select(F.col("gen").alias("at"), F.col("model_path").alias("look"), F.col("fitness").alias("parent_fitness"))
    return keyed.join(fit, ["at", "look"], "left").select("child", "parent", "parent_fitness")
