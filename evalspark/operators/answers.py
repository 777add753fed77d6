"""Best-of-N answer selection.

``candidates``: keys (benchmark, filter), sample_id, model_name, ord, correct and what a method looks at. Every method
returns one row per sample: the keys, sample_id, model_name (the selected one), correct.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.sources.tables import Tables

KEYS = ("benchmark", "filter")


def sequence_logprob(tokens: Column) -> Column:
    """Sum over positions of the first entry's log probability; tokens: array of arrays of structs with ``logprob``."""
    return F.aggregate(tokens, F.lit(0.0), lambda a, x: a + x[0]["logprob"])


def self_certainty(tokens: Column) -> Column:
    """-sum(ln V + logprob) / (n * V), V the entries at the first position; 0 if n or V is 0; it must be above 0."""
    v = F.size(tokens[0])
    total = F.aggregate(tokens, F.lit(0.0), lambda a, x: a + F.aggregate(x, F.lit(0.0), lambda b, y: b + F.ln(v) + y["logprob"]))
    value = -total / (F.size(tokens) * v)
    checked = F.when(value > 0, value).otherwise(F.raise_error(F.lit("self-certainty must be positive")).cast("double"))
    return F.when(F.size(tokens) == 0, F.raise_error(F.lit("no tokens")).cast("double")).when(v == 0, 0.0).otherwise(checked)


def best_by(candidates: DataFrame, value: Column, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per sample the candidate with the highest value, the first place on ties."""
    best = F.max_by(F.struct("model_name", "correct"), F.struct(value.alias("v"), (-F.col("ord")).alias("o")))
    return candidates.groupBy(*keys, "sample_id").agg(best.alias("b")).select(*keys, "sample_id", "b.*")


def by_score(candidates: DataFrame, score: Column, keys: Sequence[str] = KEYS) -> DataFrame:
    """Judge scores; a missing one (-1) counts as 1."""
    return best_by(candidates, F.when(score == -1, 1).otherwise(score), keys)


def by_index(candidates: DataFrame, verdicts: DataFrame, draw: Column, keys: Sequence[str] = KEYS) -> DataFrame:
    """The candidate that the judge's index names (places count from 0; negative ones from the end, but -1).

    All answers alike, or no valid index: a random one. ``verdicts``: sample_id, choice; ``draw``: whole random number
    of a sample.
    """
    order = Window.partitionBy(*keys, "sample_id").orderBy("ord")
    alike = F.max("answer").over(Window.partitionBy(*keys, "sample_id")) == F.min("answer").over(Window.partitionBy(*keys, "sample_id"))
    rows = candidates.withColumns({"at": F.row_number().over(order) - 1, "n": F.count("*").over(Window.partitionBy(*keys, "sample_id")), "alike": alike, "lucky": draw})
    rows = rows.join(verdicts.select("sample_id", "choice"), "sample_id", "left")
    valid = ~F.col("alike") & (F.col("choice") != -1) & (F.col("choice") < F.col("n")) & (F.col("choice") >= -F.col("n"))
    pick = F.when(F.coalesce(valid, F.lit(False)), F.when(F.col("choice") < 0, F.col("choice") + F.col("n")).otherwise(F.col("choice"))).otherwise(F.pmod("lucky", "n"))
    return rows.where(F.col("at") == pick).select(*keys, "sample_id", "model_name", "correct")


def tournament(candidates: DataFrame, pairs: DataFrame | Callable[[DataFrame], DataFrame], seed_draw: Callable[[Column, int], Column], rounds: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Shuffle, pair neighbours, the loser leaves, an odd one waits; again until one is left.

    ``pairs``: sample_id, a, b (places, a < b), winner (0 for a, 1 for b, -1 unparsable: random), as a table of every pair
    that may meet, or as a function that adds the winner to the pairs that do (keys, sample_id, match, a, b, and a = b for
    one that waits) and keeps their other columns. A table takes one job per round; a function that only adds columns needs
    one shuffle for all rounds. ``rounds`` is the logarithm of the number of candidates, rounded up.
    """
    tables, where = Tables(candidates.sparkSession), [*keys, "sample_id"]
    table = isinstance(pairs, DataFrame)
    judge = (lambda met: met.join(pairs.select("sample_id", "a", "b", "winner"), ["sample_id", "a", "b"], "left")) if table else pairs
    left = candidates.select(*where, "ord", F.struct("model_name", "correct").alias("row"))
    for k in range(rounds):
        mixed = seed_draw(F.col("sample_id") * 64 + F.col("ord"), k)
        place = F.row_number().over(Window.partitionBy(*where).orderBy(mixed, "ord")) - 1
        placed = left.withColumn("match", F.floor(place / 2))
        ends = [F.min("ord").alias("a"), F.max("ord").alias("b"), F.min_by("row", "ord").alias("row_a"), F.max_by("row", "ord").alias("row_b")]
        judged = judge(placed.groupBy(*where, "match").agg(*ends))
        coin = F.pmod(seed_draw(F.col("sample_id") + F.col("match"), 100 + k), F.lit(2))
        side = F.when(F.coalesce("winner", F.lit(-1)).isin(0, 1), F.col("winner")).otherwise(coin)
        stay = judged.select(*where, *(F.when(side == 0, F.col(a)).otherwise(F.col(b)).alias(c) for a, b, c in (("a", "b", "ord"), ("row_a", "row_b", "row"))))
        if table:
            stay = tables.save(stay, "round")
            if k:
                tables.drop(left)
        left = stay
    return left.select(*where, "row.*")


def numbered_prompt(candidates: DataFrame, question: str, answer: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per sample one prompt that numbers all submissions."""
    at = F.row_number().over(Window.partitionBy(*keys, "sample_id").orderBy("ord"))
    item = F.struct("at", F.concat(F.lit("Submission "), F.col("at").cast("string"), F.lit(":\n"), F.col(answer)).alias("text"))
    rows = candidates.withColumn("at", at).groupBy(*keys, "sample_id").agg(F.first(question).alias("q"), F.array_sort(F.collect_list(item)).alias("items"))
    return rows.select(*keys, "sample_id", F.concat(F.lit("Question:\n"), "q", F.lit("\n\n"), F.array_join(F.transform("items", lambda x: x["text"]), "\n\n")).alias("prompt"))


def pair_prompt(question: Column, a: Column, b: Column) -> Column:
    return F.format_string("Question:\n%s\n\nAnswer A:\n%s\n\nAnswer B:\n%s", question, a, b)


def single_prompt(question: Column, answer: Column) -> Column:
    return F.format_string("Question:\n%s\n\nAnswer:\n%s", question, answer)


def selected_accuracy(selected: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per key: correct selections over all, 0 if there are none."""
    return selected.groupBy(*keys).agg(F.count_if("correct").alias("correct"), F.count("*").alias("n")).withColumn("accuracy", F.coalesce(F.try_divide("correct", "n"), F.lit(0.0)))


def selected_shares(selected: DataFrame, models: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per key and model the percentage of selections; models that were never selected have 0."""
    total = selected.groupBy(*keys).agg(F.count("*").alias("n"))
    each = selected.groupBy(*keys, "model_name").agg(F.count("*").alias("picked"))
    rows = models.select(*keys, "model_name").distinct().join(total, list(keys)).join(each, [*keys, "model_name"], "left")
    return rows.select(*keys, "model_name", F.coalesce("picked", F.lit(0)).alias("picked"), (100.0 * F.coalesce("picked", F.lit(0)) / F.col("n")).alias("share"))


def every_method(parts: dict[str, DataFrame], keys: Sequence[str] = KEYS) -> DataFrame:
    """All methods' accuracies in one table."""
    out = None
    for name, selected in parts.items():
        rows = selected_accuracy(selected, keys).withColumn("method", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def attached_scores(rows: DataFrame, name: str, score: Callable[[pd.DataFrame], pd.Series], batch_rows: int = 64, tries: int = 3) -> DataFrame:
    """rows with ``scores`` (a map) extended by a batch function's score under its name; a judge, reward or other model.

    A batch that fails is tried again, ``tries`` times in all; then its error is that of the task.
    """
    columns = rows.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scores = []
            for at in range(0, len(batch), batch_rows):
                part = batch.iloc[at : at + batch_rows]
                for left in reversed(range(tries)):
                    try:
                        new = score(part).astype(float)
                        break
                    except Exception:
                        if not left:
                            raise
                scores.append(new if new.index.equals(part.index) else new.reindex(part.index))
            if scores:
                yield batch.assign(new_score=pd.concat(scores))[[*columns, "new_score"]]

    scored = rows.mapInPandas(run, f"{kinds}, new_score double")
    old = F.col("scores") if "scores" in columns else F.create_map().cast("map<string,double>")
    kept = F.map_filter(old, lambda k, v: k != name)
    return scored.withColumn("scores", F.map_concat(kept, F.create_map(F.lit(name), F.col("new_score")))).drop("new_score")


def drawn_parents(archive: DataFrame, children: int, draw: Callable[[Column, int], Column], seeds: DataFrame | None = None) -> DataFrame:
    """child, parent (ord): two distinct members of the archive for each new model, or of the seeds if it has under two."""
    rows = archive.select("ord")
    if seeds is not None:
        size = rows.agg(F.count("*").alias("n"))
        rows = rows.join(F.broadcast(size), F.lit(True)).where("n >= 2").select("ord").unionByName(seeds.select("ord").join(F.broadcast(size), F.lit(True)).where("n < 2").select("ord"))
    each = rows.withColumn("child", F.explode(F.sequence(F.lit(0), F.lit(children - 1))))
    rank = F.row_number().over(Window.partitionBy("child").orderBy(draw(F.col("child") * 100_003 + F.col("ord"), 3), "ord"))
    return each.withColumn("rank", rank).where("rank <= 2").select("child", "rank", F.col("ord").alias("parent"))


def rebuilt(paths: DataFrame, rows: DataFrame) -> DataFrame:
    """Full rows of surviving paths in their order; of several rows with a path the later one."""
    last = rows.groupBy("model_path").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "model_path"]), "ord").alias("r"))
    return paths.select("place", "model_path").join(last, "model_path").select("place", "model_path", "r.*")
