"""Readers of evaluation logs: per-sample JSON lines, result files, and their normalised form.

File and directory names carry the model, benchmark and task.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalspark.functions.text import group_of_file, is_correct, is_correct_rate, mean_of
from evalspark.operators.order import BROADCAST_ROWS, placed
from evalspark.sources.files import read_texts
from evalspark.sources.tables import Tables

JUDGE = "llm_as_a_judge"
#: Documents, arguments and metrics differ per benchmark, so they stay variants.
SAMPLE_SCHEMA = "doc_id long, doc variant, target variant, arguments variant, resps variant, filtered_resps variant, filter string, metrics variant"


def read_samples(spark: SparkSession, root: str, benchmark: str, judge: bool = False) -> DataFrame:
    """One row per line of ``<root>/<model>/samples_<benchmark>*.jsonl``: file_name, model_name, line (its place), v (variant).

    Judge files belong to the judge variant alone.
    """
    rows = judge_files(read_texts(spark, root, rf"^samples_{re.escape(benchmark)}.*\.jsonl$"), judge)
    # A generator's column is worked out once; a projected one would be again in every filter that is pushed below it.
    once = F.explode(F.array(F.try_parse_json("value"))).alias("v")
    return rows.select("file_name", F.col("folder").alias("model_name"), "line", once).where("v is not null")


def judge_files(files: DataFrame, judge: bool) -> DataFrame:
    """The judge's files, or all others."""
    return files.where(F.contains("file_name", F.lit(JUDGE)) == F.lit(judge))


def filtered_population(samples: DataFrame, value: str, keep: Sequence[str] = ()) -> DataFrame:
    """Rows whose ``filter`` is the value, with their place among these in the file; a file may be larger than a task.

    ``keep``: the columns that go on, all if empty. Rows as they are read stand in order in each split of a file, so a table
    of splits gives the places; rows that were dealt out anew are sorted.
    """
    keep, tables = keep or samples.columns, Tables(samples.sparkSession)
    all_ = samples.where(F.try_variant_get("v", "$.filter", "string") == value).select(*dict.fromkeys([*keep, "model_name", "file_name", "line"]))
    rows = all_.withColumn("at_", F.monotonically_increasing_id())
    rows = rows.withColumns({"part_": F.col("line.part"), "split_": F.col("line.split"), "moved_": F.shiftright("line.row", 33) != F.shiftright("at_", 33)})
    rows = tables.save(rows if "line" in keep else rows.drop("line"), "population")
    split = ["model_name", "file_name", "part_", "split_"]
    before = Window.partitionBy("model_name", "file_name").orderBy("part_", "split_").rowsBetween(Window.unboundedPreceding, -1)
    per = rows.groupBy(*split).agg(F.min("at_").alias("first_"), F.count("*").alias("n_"), F.bool_or("moved_").alias("moved"))
    per = tables.save(per.withColumn("ahead_", F.coalesce(F.sum("n_").over(before), F.lit(0))), "splits")
    if not per.where("moved").isEmpty():
        return placed(all_, ["line"], "ord", ["model_name", "file_name"], start=0).select(*keep, "ord")
    found = rows.join(F.broadcast(per) if per.count() <= BROADCAST_ROWS else per, split)
    return found.select(*keep, (F.col("at_") - F.col("first_") + F.col("ahead_")).alias("ord"))


def task_files(files: DataFrame, judge: bool = False) -> DataFrame:
    """(task, model_name, file_name) from file names: the task stands before ``_2025``; judge files only on request."""
    rows = files if judge else judge_files(files, False)
    task = F.substring_index(F.regexp_replace("file_name", "^samples_", ""), "_2025", 1)
    return rows.select(task.alias("task"), "model_name", "file_name").distinct()


def later_wins(rows: DataFrame, *keys: str) -> DataFrame:
    """Of rows with one key the last by file and line."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("file_name"), F.desc("line")))
    return rows.withColumn("again", rank).where("again = 1").drop("again")


@dataclass(frozen=True)
class Spec:
    """How a benchmark's lines become samples. Paths are variant paths; an id part of None is left out."""

    prefix: str
    metric: str
    filter: str | None = None
    problem: str = "$.doc.question"
    prediction: str = "$.filtered_resps[0]"
    answer: str = "$.target"
    subject: str | None = None
    by_file: bool = False
    judge: bool = False


SPECS: dict[str, Spec] = {
    "gsm8k": Spec("gsm8k", "exact_match", "flexible-extract", answer="$.doc.answer"),
    "gsm8k_llama": Spec("gsm8k_llama", "exact_match", "flexible_extract", answer="$.doc.answer"),
    "ifeval": Spec("ifeval", "prompt_level_strict_acc", problem="$.doc.prompt", prediction="$.resps[0][0]"),
    "mmlu": Spec("mmlu", "exact_match", "strict_match", subject="$.doc.subject"),
    "mmlu_pro": Spec("mmlu_pro", "exact_match", "custom-extract", subject="$.doc.category"),
    "arc_challenge": Spec("arc_challenge", "exact_match", "remove_whitespace"),
    "bbh": Spec("bbh_cot_fewshot", "exact_match", "get-answer", problem="$.doc.input", by_file=True),
    "hendrycks_math": Spec("hendrycks_math", "exact_match", problem="$.doc.problem", answer="$.doc.solution", by_file=True),
    "minerva_math": Spec("minerva_math", "exact_match", problem="$.doc.problem", answer="$.doc.solution", by_file=True),
    "gpqa": Spec("gpqa", "exact_match", "flexible-extract", problem="$.doc.Question", answer="$.doc.answer"),
    "humaneval": Spec("humaneval", "pass@1", "create_test", problem="$.doc.prompt"),
    "mbpp": Spec("mbpp", "pass_at_1", "extract_code", problem="$.doc.text"),
    "aime": Spec("aime", "exact_match", problem="$.doc.Problem", answer="$.doc.Answer"),
}
#: The four rates of instruction following, and whether they are lists of flags.
RATES = {"prompt_level_strict_acc": False, "inst_level_strict_acc": True, "prompt_level_loose_acc": False, "inst_level_loose_acc": True}


def rates() -> dict[str, Column]:
    """Instruction-following rates of a line: list metrics as means, flags as 0 or 1."""
    out = {}
    for name, listed in RATES.items():
        out[name] = mean_of(F.try_variant_get("v", f"$.{name}", "array<boolean>")) if listed else F.try_variant_get("v", f"$.{name}", "boolean").cast("double")
    return out


def normalized(samples: DataFrame, name: str) -> DataFrame:
    """model_name, sample_id, correct, score, problem, generation, prediction, answer; later duplicates win."""
    s = SPECS[name]
    if name == "ifeval" and s.metric not in RATES:
        raise ValueError(f"no such rate: {s.metric}")
    text = lambda p: F.try_variant_get("v", p, "string")
    rows = samples.where(F.try_variant_get("v", "$.filter", "string") == s.filter) if s.filter else samples
    doc = text("$.doc_id")
    if s.subject:
        doc = F.concat_ws("_", text(s.subject), doc)
    elif s.by_file:
        doc = F.concat_ws("_", group_of_file(F.col("file_name"), f"samples_{s.prefix}_"), doc)
    score = rates()[s.metric] if name == "ifeval" else F.try_variant_get("v", f'$["{s.metric}"]', "double")
    correct = is_correct_rate(score) if name == "ifeval" else is_correct(score)
    out = rows.select("model_name", "file_name", "line", doc.alias("sample_id"), correct.alias("correct"), score.alias("score"), text(s.problem).alias("problem"), text("$.resps[0][0]").alias("generation"), text(s.prediction).alias("prediction"), text(s.answer).alias("answer"))
    return later_wins(out, "model_name", "sample_id").drop("file_name", "line")


def read_results(spark: SparkSession, root: str, pattern: str = r"^results.*\.json$", section: str = "results") -> DataFrame:
    """model_name, file_name, benchmark, metric, value of every result file, from its results or its groups."""
    rows = read_texts(spark, root, pattern, whole=True).withColumnRenamed("folder", "model_name")
    v = F.try_parse_json("value")
    per = rows.select("model_name", "file_name", F.explode(F.try_variant_get(v, f"$.{section}", "map<string,variant>")).alias("benchmark", "metrics"))
    flat = per.select("model_name", "file_name", "benchmark", F.explode(F.col("metrics").cast("map<string,variant>")).alias("metric", "x"))
    return flat.select("model_name", "file_name", "benchmark", "metric", F.try_variant_get("x", "$", "double").alias("value"))


def main_metrics(results: DataFrame, metrics: dict[str, str]) -> DataFrame:
    """The chosen metric of each benchmark, from each model's first file."""
    wanted = [F.struct(F.lit(b).alias("benchmark"), F.lit(m).alias("metric")) for b, m in metrics.items()]
    first = results.groupBy("model_name").agg(F.min("file_name").alias("file_name"))
    return results.join(first, ["model_name", "file_name"], "left_semi").where(F.array_contains(F.array(*wanted), F.struct("benchmark", "metric")))


def groups_of(results: DataFrame, benchmark: str, all_groups: bool = False, containing: bool = False) -> DataFrame:
    """Group rows of a benchmark: all of them, every name that contains the benchmark, or the one group; the last file wins."""
    rows = results if all_groups else results.where(F.contains("benchmark", F.lit(benchmark)) if containing else F.col("benchmark") == benchmark)
    last = results.groupBy("model_name").agg(F.max("file_name").alias("file_name"))
    return rows.join(last, ["model_name", "file_name"], "left_semi")


def flattened_path(path: Column) -> Column:
    """<model>/seed_XX/<model>/file as <model>/seed_XX/file."""
    return F.regexp_replace(path, r"([^/]+)/(seed_\d+)/\1/", "$1/$2/")
