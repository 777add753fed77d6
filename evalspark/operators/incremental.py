"""Incremental and set-difference jobs: what is new, missing, kept or done."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.operators.evolution import is_interval


def latest_generation(models: DataFrame) -> DataFrame:
    """The highest n of names gen_<n>_ind_...; without one an error."""
    gen = F.regexp_extract("model_path", r"^gen_(\d+)_ind_", 1).try_cast("bigint")
    top = models.agg(F.max(gen).alias("gen"))
    return top.select(F.when(F.col("gen").isNull(), F.raise_error(F.lit("no generation")).cast("bigint")).otherwise(F.col("gen")).alias("gen"))


def keep_set(archives: DataFrame, current: int, interval: int, zero: bool = False) -> DataFrame:
    """Models of the current archive and of the archives of every interval-th generation."""
    return archives.where((F.col("gen") == current) | is_interval(F.col("gen"), interval, zero)).select("model_path").distinct()


def retention_candidates(on_disk: DataFrame, keep: DataFrame, older_than: int, interval: int, keep_dirs: Sequence[str] = ("parent_mappings",)) -> DataFrame:
    """Names that nothing keeps: not in the keep set, older than the threshold, off the interval, and parsable. A report."""
    gen = F.regexp_extract("model_path", r"^gen_(\d+)_ind_", 1).try_cast("bigint")
    rows = on_disk.where(~F.col("model_path").isin(list(keep_dirs))).withColumn("gen", gen)
    return rows.where((F.col("gen") < older_than) & ~is_interval(F.col("gen"), interval, True)).join(keep, "model_path", "left_anti")


def not_evaluated(models: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Models without a stored skill vector."""
    return models.join(evaluated.select("model_path"), "model_path", "left_anti")


def open_benchmarks(benchmarks: DataFrame, stored: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Benchmarks without a stored result, or whose result lacks one of the methods."""
    done = stored.where(F.col("method").isin(list(methods))).groupBy("benchmark").agg(F.count_distinct("method").alias("n")).where(F.col("n") == len(set(methods)))
    return benchmarks.join(done, "benchmark", "left_anti")


def missing(selected: DataFrame, evaluated: DataFrame) -> DataFrame:
    return selected.select("model_name").distinct().join(evaluated.select("model_name"), "model_name", "left_anti")


def already_scored(samples: DataFrame, scorer: str) -> DataFrame:
    """Per model: every sample carries the scorer's score."""
    return samples.groupBy("model_name").agg(F.bool_and(F.coalesce(F.map_contains_key("scores", scorer), F.lit(False))).alias("done"))


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str], overwrite: bool = False) -> DataFrame:
    """New rows in place of old ones with their keys; all old rows go if ``overwrite``."""
    return new if overwrite else old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)
