"""A training-data pipeline over ``documents``: each stage keeps or rewrites rows, the last one writes token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet under the shared
folder and reads it again for the next stage. What a stage wrote on its way goes when its result is written, and so does
the result before it. Null and empty texts leave in the first stage; all other columns, whatever their names, travel in
one struct beside those that a stage works on, and stay until the last stage. A row without a doc_id is a document like
no other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm.common import WORD, Scratch, held_out, read
from evalspark.llm.language_id import predicted, train
from evalspark.llm.mixing import mixed
from evalspark.llm.near_dedup import near_duplicates
from evalspark.llm.queries import TOKENIZERS
from evalspark.llm.sentencepiece import encoded
from evalspark.llm.substring_dedup import substring_dedup
from evalspark.sources.tables import scratch


def beside(docs: DataFrame, *used: str) -> DataFrame:
    """The columns that a stage uses, and a struct ``rest`` of all others."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in used]
    return docs.select(*used, (F.struct(*others) if others else F.struct(F.lit(None).cast("string").alias("none"))).alias("rest"))


def restored(docs: DataFrame, like: DataFrame, *used: str) -> DataFrame:
    """The columns of ``like``, in its order: those that the stage used, and others out of ``rest``."""
    return docs.select(*(F.col(c) if c in used else F.col(f"rest.`{c}`") for c in like.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, or unlike every language learned, go; a missing language is filled in."""
    found = predicted(beside(docs, "doc_id", "text", "lang"), train(docs.where(~held_out()))).where("not rejected")
    return restored(found.withColumn("lang", F.coalesce("lang", "lang_pred")), docs, "doc_id", "text", "lang")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays; of several rows with one id one stays,
    the same in every run. Shingles have five words, as every stage without a contract of its own takes."""
    kept = near_duplicates(docs.select("doc_id", "text")).where("kept and doc_id is not null").select("doc_id").distinct()
    named = beside(docs, "doc_id").join(kept, "doc_id", "left_semi")
    order = F.struct(F.xxhash64("rest.text"), F.to_json(F.struct(F.col("rest").dropFields("text").alias("r"))) if len(docs.columns) > 2 else F.lit(0))
    one = named.groupBy("doc_id").agg(F.min_by("rest", order).alias("rest"))
    return restored(one, docs, "doc_id").union(docs.where("doc_id is null"))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has too are cut; texts without such a passage stay as they are."""
    cut = substring_dedup(beside(docs, "doc_id", "text")).where("not touched or text <> ''")
    n_chars = F.when(F.col("touched"), F.length("text").cast("long")).otherwise(F.col("rest.n_chars"))
    return restored(cut.select("doc_id", "text", n_chars.alias("n_chars"), "rest"), docs, "doc_id", "text", "n_chars")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by weight: a row per epoch that takes the document; the last document of a source is cut at its budget."""
    parts = mixed(beside(docs, "doc_id", "source", "text")).where("taken > 0")
    copies = F.ceil(F.col("taken") / F.col("size")).cast("int")
    rows = parts.select("*", F.explode(F.sequence(F.lit(1), copies)).alias("copy"))
    words = F.when(F.col("copy") * F.col("size") > F.col("taken"), F.col("taken") - (F.col("copy") - 1) * F.col("size")).cast("int")
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})")), F.lit(1), words), " ")
    cut = rows.select("doc_id", "source", F.when(words.isNull(), F.col("text")).otherwise(part).alias("text"), words.isNotNull().alias("short"), "rest")
    n_chars = F.when(F.col("short"), F.length("text").cast("long")).otherwise(F.col("rest.n_chars"))
    return restored(cut.withColumn("n_chars", n_chars), docs, "doc_id", "source", "text", "n_chars")


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, the text decoded from them, and whether it is the input exactly."""
    return encoded(docs, f"{TOKENIZERS}/piece_bpe_32k.model").select("doc_id", "n_tokens", "ids", "text", "exact")


STAGES = [
    ("language_id", language_id),
    ("minhash_near_dedup", near_dedup),
    ("substring_dedup", substrings),
    ("mix_sources", mix),
    ("sentencepiece", sentencepiece),
]

#: SQL cannot express the language models, the signatures' candidates or the pieces; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, docs, before = Scratch(spark), read(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = tables.save(stage(spark, docs, sf_dir), name)
        tables.drop(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
