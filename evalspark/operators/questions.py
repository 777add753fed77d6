"""Benchmark questions: sampling, filtering, formatting and reports.

``questions``: benchmark, subgroup, idx, question (and choices, answer, ...).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions.hashing import draw
from evalspark.functions.text import without_options
from evalspark.operators.order import placed

LETTERS = "ABCDEFGHIJ"


def stratified(questions: DataFrame, n: int, draw: Column, by: Sequence[str] = ("subgroup",)) -> DataFrame:
    """n questions per subgroup without replacement (all, if there are fewer), in random order."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(draw, "idx"))
    return questions.withColumn("rank", rank).where(F.col("rank") <= n)


def flat_sample(questions: DataFrame, n: int, draw: Column) -> DataFrame:
    return questions.orderBy(draw, "idx").limit(n)


def valid_only(questions: DataFrame, invalid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(questions not in the invalid list, dropped per subgroup with a total row). Options are cut before comparing."""
    key = questions.withColumn("bare", without_options(F.col("question")))
    bad = invalid.select("subgroup", without_options(F.col("question")).alias("bare")).distinct()
    dropped = key.join(bad, ["subgroup", "bare"], "left_semi").rollup("subgroup").count()
    return key.join(bad, ["subgroup", "bare"], "left_anti").drop("bare"), dropped


def question_ids(questions: DataFrame) -> DataFrame:
    """{benchmark in lower case and underscores}[_{subgroup}]_{index inside the subgroup}."""
    name = F.regexp_replace(F.lower("benchmark"), r"[\s-]+", "_")
    rows = placed(questions, ["idx"], "at_subgroup", ["benchmark", "subgroup"], start=0)
    return rows.withColumn("question_id", F.concat_ws("_", name, "subgroup", F.col("at_subgroup").cast("string"))).drop("at_subgroup")


def with_options(question: Column, choices: Column) -> Column:
    """The question, and a line ``A) choice`` for each choice."""
    lines = F.transform(choices, lambda c, i: F.concat(F.substring(F.lit(LETTERS), i + 1, F.lit(1)), F.lit(") "), c))
    return F.trim(F.concat_ws("\n", question, F.array_join(lines, "\n")), F.lit(" \n"))


#: How each data set shows a question: its text column, and its choices if it has any.
FORMATS: dict[str, tuple[str, str | None]] = {
    "mmlu": ("question", "choices"),
    "mmlu_pro": ("question", "options"),
    "bbh": ("input", None),
    "math": ("problem", None),
    "gsm8k": ("question", None),
    "humaneval": ("prompt", None),
    "mbpp": ("text", None),
    "gpqa": ("Question", "shuffled"),
}


#: The question type of each data set.
TYPES = {
    "mmlu": "multiple_choice",
    "mmlu_pro": "multiple_choice",
    "bbh": "reasoning",
    "math": "math_problem",
    "gsm8k": "math_word_problem",
    "humaneval": "code_generation",
    "mbpp": "code_generation",
    "gpqa": "multiple_choice",
}


def formatted(rows: DataFrame, dataset: str) -> DataFrame:
    text, choices = FORMATS[dataset]
    if choices == "shuffled":
        rows = rows.withColumn("shuffled", gpqa_choices()[0])
    body = without_options(F.col(text)) if dataset == "bbh" else F.col(text)
    return rows.withColumn("content", F.trim(body, F.lit(" \n")) if choices is None else with_options(body, F.col(choices)))


def final_answer(solution: Column) -> Column:
    """What stands behind the last ``####``; the whole answer without one."""
    return F.when(F.contains(solution, F.lit("####")), F.trim(F.substring_index(solution, "####", -1), F.lit(" \n"))).otherwise(solution)


def letter(index: Column) -> Column:
    return F.substring(F.lit(LETTERS), index + 1, F.lit(1))


def shuffled_choices(correct: Column, wrong: Sequence[Column], key: Column) -> tuple[Column, Column]:
    """(choices in an order that depends on the question's number alone, place of the correct one from 0)."""
    every = [correct, *wrong]
    item = lambda i, c: F.struct(draw(key * len(every) + i, 9).alias("h"), F.lit(i).alias("i"), c.alias("c"))
    order = F.array_sort(F.array(*(item(i, c) for i, c in enumerate(every))))
    return F.transform(order, lambda x: x["c"]), F.array_position(F.transform(order, lambda x: x["i"]), 0).cast("int") - 1


def gpqa_choices() -> tuple[Column, Column]:
    return shuffled_choices(F.col("Correct Answer"), [F.col(f"Incorrect Answer {i}") for i in (1, 2, 3)], F.col("idx"))


def metadata(rows: DataFrame, dataset: str) -> DataFrame:
    """``rows`` of a data set, with the column names it is published with, and their metadata map.

    Every map has benchmark, question_type and, where there is one, subgroup; the rest is what the data set tells about
    answers. Optional columns that are absent have no entry; lists are JSON.
    """
    col, have = F.col, set(rows.columns)
    text = lambda c: col(c).cast("string")
    fields: dict[str, Column]
    if dataset == "mmlu":
        fields = {"answer_index": text("answer"), "answer_letter": letter(col("answer")), "answer_text": F.try_element_at("choices", col("answer") + 1), "num_choices": F.size("choices").cast("string")}
    elif dataset == "mmlu_pro":
        fields = {"answer_letter": text("answer"), "answer_index": text("answer_index"), "num_choices": F.size("options").cast("string"), **optional(have, original_question_id="question_id", source="src")}
    elif dataset == "bbh":
        fields = {"answer": text("target")}
    elif dataset == "math":
        fields = optional(have, difficulty="level", solution="solution", category_from_data="type")
    elif dataset == "gsm8k":
        fields = {"answer": final_answer(col("answer")), "full_solution": text("answer")}
    elif dataset == "humaneval":
        fields = {"task_id": text("task_id"), "entry_point": text("entry_point"), "language": F.lit("python"), **optional(have, canonical_solution="canonical_solution")}
    elif dataset == "mbpp":
        fields = {"task_id": text("task_id"), "language": F.lit("python"), **optional(have, canonical_solution="code")}
        fields |= {"test_cases": F.to_json("test_list")} if "test_list" in have else {}
    else:
        at = gpqa_choices()[1]
        given = lambda c: text(c) if c in have else F.lit("")
        fields = {"answer_index": at.cast("string"), "answer_letter": letter(at), "answer_text": text("Correct Answer"), "num_choices": F.lit("4"), "subdomain": given("Subdomain"), "difficulty": given("Writer's Difficulty Estimate")}
    head = {"benchmark": F.lit(dataset), "question_type": F.lit(TYPES[dataset])} | optional(have, subgroup="subgroup")
    return rows.withColumn("metadata", F.create_map(*(x for k, c in {**head, **fields}.items() for x in (F.lit(k), c))))


def optional(have: set[str], **columns: str) -> dict[str, Column]:
    return {k: F.col(c).cast("string") for k, c in columns.items() if c in have}


def question_store(parts: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(question_id, content, metadata of all data sets; added and failed counts per data set). Empty contents fail.

    ``parts``: subgroup, idx, content and metadata by data set. All sets get their ids in one sort.
    """
    every = None
    for name, rows in parts.items():
        rows = rows.select(F.lit(name).alias("benchmark"), "subgroup", "idx", "content", "metadata")
        every = rows if every is None else every.unionByName(rows)
    ok = F.coalesce(F.length("content") > 0, F.lit(False))
    report = every.groupBy(F.col("benchmark").alias("dataset")).agg(F.count_if(ok).alias("added"), F.count_if(~ok).alias("failed"))
    return question_ids(every).where(ok).select("question_id", "content", "metadata"), report


def validity_report(verdicts: DataFrame) -> DataFrame:
    """Per subject: valid and invalid questions and their shares."""
    per = verdicts.groupBy("subject").agg(F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"))
    n = F.col("valid") + F.col("invalid")
    return per.withColumns({"valid_share": F.col("valid") / n, "invalid_share": F.col("invalid") / n})
