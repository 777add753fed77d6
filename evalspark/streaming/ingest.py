"""Incremental ingest: new log files upsert the fact table as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from evalspark.sources.tables import Tables


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return rows.withColumn("again", rank).where("again = 1").drop("again")


def upsert_stream(spark: SparkSession, source: str, schema: StructType, target: str, keys: list[str], order: str, checkpoint: str) -> StreamingQuery:
    """Follows JSON files under ``source``; each batch appends to ``target`` (Parquet, one directory per batch).

    Appending is idempotent per batch: a batch that is run again replaces its own directory. ``current`` gives the
    rows that hold, the latest of each key.
    """

    def write(batch: DataFrame, number: int) -> None:
        latest(batch, keys, order).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return spark.readStream.schema(schema).json(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str, keys: list[str], order: str) -> DataFrame:
    return latest(spark.read.parquet(target), keys, order).drop("batch")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{Tables(spark).root}/{name}"
