"""Parsers and labels as column expressions; nothing here leaves the JVM.

``(?d)`` makes the dot stop at line feeds only, ``(?s)`` makes it match them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _group(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def model_name(path: Column) -> Column:
    """Behind the last ``__models__`` separator if there is one, else the last part of the path; null for empty paths."""
    clean = F.rtrim(path, F.lit("/"))
    marked = F.when(path.contains("__models__"), F.substring_index(path, "__models__", -1)).otherwise(F.substring_index(clean, "/", -1))
    return F.when(F.length(path) > 0, F.regexp_replace(marked, "^[_/]+", ""))


def is_seed_model(name: Column) -> Column:
    """Evolved models are named gen_<n>_ind_<n>...; every other name is a seed."""
    return ~name.rlike(r"^gen_\d+_ind_(\d+)")


def is_seed_label(name: Column) -> Column:
    """The looser rule of the reports: no gen_<n> anywhere."""
    return ~name.rlike(r"gen_\d+")


def generation(name: Column) -> Column:
    return F.coalesce(_group(name, r"gen_(\d+)").try_cast("bigint"), F.lit(0).cast("bigint"))


def task_number(name: Column, otherwise: float | None = -1) -> Column:
    """Number of task_<n>_...; else the sentinel: -1 orders such names first, null (or infinity) last."""
    return F.coalesce(_group(name, r"^task_(\d+)_").try_cast("bigint"), F.lit(otherwise).cast("bigint"))


def composite_id(*parts: Column, doc_id: Column) -> Column:
    return F.concat_ws("_", F.coalesce(*parts), doc_id.cast("string"))


def group_of_file(file_name: Column, prefix: str) -> Column:
    """File name without its prefix and without the part behind the last underscore."""
    bare = F.when(F.startswith(file_name, F.lit(prefix)), F.substring(file_name, len(prefix) + 1, 1 << 20)).otherwise(file_name)
    return F.regexp_replace(bare, r"_[^_]*$", "")


def metric_spec(spec: Column) -> tuple[Column, Column]:
    """``metric,filter``: the first and the last part."""
    return F.substring_index(spec, ",", 1), F.substring_index(spec, ",", -1)


def is_correct(metric: Column) -> Column:
    return F.coalesce(metric.cast("double") == 1.0, F.lit(False))


def is_correct_rate(rate: Column) -> Column:
    """Instruction-following rates: any rate above 0 counts."""
    return F.coalesce(rate.cast("double") > 0, F.lit(False))


def mean_of(flags: Column) -> Column:
    return F.try_divide(F.aggregate(flags, F.lit(0.0), lambda a, x: a + F.when(x, 1.0).otherwise(0.0)), F.size(flags))


def strip_chat(text: Column, system: str, user: str, assistant: str, begin: str, end: str) -> Column:
    """The text behind the last system tag, then the last user tag, without assistant tag, begin and end marks."""
    x = F.substring_index(F.substring_index(text, system, -1), user, -1)
    for mark in (assistant, begin, end):
        x = F.replace(x, F.lit(mark), F.lit(""))
    return F.trim(x, F.lit(" \n\t\r"))


def extract_answer(text: Column) -> Column:
    """From a boxed answer (to the last closing brace), else behind ``####``, else behind ``Answer:``, else a notice."""
    notice = F.lit("No answer found.")
    boxed = F.when(text.rlike(r"(?d)\\boxed\{.*\}"), F.regexp_extract(text, r"(?s)\\boxed\{(.*)\}", 1))
    hashes = F.when(F.contains(text, F.lit("####")), F.trim(F.regexp_extract(text, r"(?s)####(.*)$", 1), F.lit(" \n\t\r")))
    answer = F.when(F.contains(text, F.lit("Answer:")), F.regexp_extract(text, r"(?s)Answer:(.*)$", 1))
    return F.coalesce(F.when(boxed != notice, boxed), hashes, answer, notice)


def json_block(text: Column) -> Column:
    """The first fenced JSON block that parses, else the first brace span that does; control characters are removed on a retry."""

    def first(x: Column) -> Column:
        fenced = F.regexp_extract_all(x, F.lit(r"(?s)```json\s*(.*?)\s*```"), F.lit(1))
        braces = F.regexp_extract_all(x, F.lit(r"(?s)(\{.*?\})"), F.lit(1))
        good = F.filter(F.concat(fenced, braces), lambda s: F.try_parse_json(s).isNotNull())
        return F.try_element_at(good, F.lit(1))

    return F.coalesce(first(text), first(F.regexp_replace(text, r"[\x00-\x1F\x7F]", "")))


def decision_index(text: Column) -> Column:
    """The number behind ``DECISION:`` less one; -1 without one."""
    return F.coalesce(_group(text, r"DECISION:\s*(-?\d+)").try_cast("int") - 1, F.lit(-1))


def decision_pair(text: Column) -> Column:
    """0 for [[A]], 1 for [[B]], else -1."""
    return F.when(F.contains(text, F.lit("[[A]]")), 0).when(F.contains(text, F.lit("[[B]]")), 1).otherwise(-1)


def decision_score(text: Column) -> Column:
    return F.coalesce(_group(text, r"\[\[(\d+)\]\]").try_cast("int"), F.lit(-1))


def decision_yes(text: Column) -> Column:
    """Of ``Decision: Yes`` or ``No``; null without either."""
    return _group(text, r"Decision: (Yes|No)") == "Yes"


def decision_last_line(text: Column) -> Column:
    """Of a line that ends with ``DECISION: Yes`` or ``No`` in any case."""
    return F.lower(_group(text, r"(?im)DECISION:\s*(yes|no)\s*$")) == "yes"


def valid_open_question(text: Column) -> Column:
    """Yes behind the first ``DECISION:``."""
    return F.contains(text, F.lit("DECISION:")) & F.contains(F.regexp_extract(text, r"(?s)DECISION:(.*)$", 1), F.lit("Yes"))


def split_options(text: Column) -> tuple[Column, Column]:
    """(question, options): lines behind ``Options:``; those with Yes or No are just that."""
    parts = F.split(F.trim(F.regexp_extract(text, r"(?s)Options:(.*)$", 1), F.lit(" \n")), "\n")
    short = F.transform(parts, lambda o: F.when(F.contains(o, F.lit("Yes")), "Yes").when(F.contains(o, F.lit("No")), "No").otherwise(F.trim(o)))
    return F.trim(F.substring_index(text, "Options:", 1), F.lit(" \n")), F.when(F.contains(text, F.lit("Options:")), short).otherwise(F.array().cast("array<string>"))


def without_options(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\nOptions:")), F.substring_index(text, "\nOptions:", 1)).otherwise(F.substring_index(text, " Options:", 1))


def describe(fields: Column) -> Column:
    """``Key: value`` lines of a map, without task_family and done; underscores of keys are spaces."""
    kept = F.map_filter(fields, lambda k, v: ~k.isin("task_family", "done"))
    line = F.transform(F.map_entries(kept), lambda e: F.concat(F.upper(F.substring(e["key"], 1, 1)), F.replace(F.lower(F.substring(e["key"], 2, 1 << 20)), F.lit("_"), F.lit(" ")), F.lit(": "), e["value"]))
    return F.array_join(line, "\n")


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, r'[<>:"/\\|?*]', "_")


def safe_id(name: Column) -> Column:
    return F.replace(name, F.lit("/"), F.lit("_"))


def title(name: Column) -> Column:
    """snake_case as Title Words."""
    return F.array_join(F.transform(F.split(name, "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20)))), " ")


def short_label(name: Column, rules: list[tuple[str, str]]) -> Column:
    """The label of the first rule whose text the name holds, else the name."""
    out = F.lit(None).cast("string")
    for text, label in rules:
        out = F.coalesce(out, F.when(F.contains(F.lower(name), F.lit(text)), F.lit(label)))
    return F.coalesce(out, name)


def exact_match(submission: Column, target: Column) -> Column:
    """1.0 or 0.0: the submission, trimmed and lower-cased, is the lower-cased target."""
    return F.when(F.lower(F.trim(submission, F.lit(" \n\t\r"))) == F.lower(target), 1.0).otherwise(0.0)
