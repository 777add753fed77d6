"""Files that carry names: <folder>/<name>, or folder=<folder>/name=<name>/part-... as Spark itself can write them."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Lines of a part file that ``write_lines`` writes: its parts are compressed, so each is read by one task.
PART_LINES = 1 << 18
#: Files up to which the table of their names is broadcast; beyond, the engine decides by its size.
BROADCAST_FILES = 100_000


def named(path: Column) -> tuple[Column, Column]:
    """(folder, name) of a file in either layout."""
    above, file = F.substring_index(F.substring_index(path, "/", -3), "/", 2), F.substring_index(path, "/", -1)
    first, second = F.substring_index(above, "/", 1), F.substring_index(above, "/", -1)
    parts = F.startswith(first, F.lit("folder=")) & F.startswith(second, F.lit("name="))
    folder = F.when(parts, F.substring(first, 8, 1 << 30)).otherwise(second)
    folder = F.when(F.contains(folder, F.lit("=")), F.regexp_replace(folder, r"^\w+=", "")).otherwise(folder)
    return folder, F.when(F.startswith(second, F.lit("name=")), F.substring(second, 6, 1 << 30)).otherwise(file)


def part_number(path: Column) -> Column:
    """Grows with the place of a part, as Spark names them, among those of one name; 0 of other files."""
    number = lambda pattern: F.coalesce(F.regexp_extract(F.substring_index(path, "/", -1), pattern, 1).try_cast("bigint"), F.lit(0))
    return F.when(F.startswith(F.substring_index(path, "/", -1), F.lit("part-")), F.shiftleft(number(r"^part-(\d+)-"), 32) + number(r"[.-]c(\d+)\.")).otherwise(F.lit(0).cast("bigint"))


def file_names(read: DataFrame, name: str, others: bool = False) -> DataFrame:
    """path, folder, file_name, part and ``wanted`` of the files behind ``read`` whose name matches a pattern, or of all."""
    paths = [re.sub(r"^([\w+.-]+):///", r"\1:/", p) for p in read.inputFiles()]  # as lines name them
    folder, file_name = named(F.col("path"))
    files = read.sparkSession.createDataFrame(pa.table({"path": pa.array(paths, pa.string())}))
    files = files.select("path", folder.alias("folder"), file_name.alias("file_name"), part_number(F.col("path")).alias("part")).withColumn("wanted", F.col("file_name").rlike(name))
    files = files if others else files.where("wanted")
    return F.broadcast(files) if len(paths) <= BROADCAST_FILES else files


def with_files(rows: DataFrame, read: DataFrame, name: str) -> DataFrame:
    """``rows`` (path and value) of the files behind ``read`` whose name matches a pattern, with their folder, file_name and
    part: paths are taken apart once a file, not once a line."""
    rows = rows.join(file_names(read, name, others=True), "path", "left").where("wanted is null or wanted")
    unknown = F.raise_error(F.concat(F.lit("a file that was not listed: "), "path")).cast("string")
    return rows.withColumn("value", F.when(F.col("wanted").isNull(), unknown).otherwise(F.col("value"))).drop("wanted")


def read_texts(spark: SparkSession, root: str, name: str, whole: bool = False) -> DataFrame:
    """folder, file_name, value of the files under ``root`` whose name matches a pattern: a row per line, or per file.

    Lines also have ``line``: the part of the file, the byte at which the split of the part begins that holds the line,
    and a number that grows inside the split. So lines of one file are in the order of ``line``, however the file is
    split and whichever tasks read its splits.
    """
    rows = spark.read.text(root, wholetext=whole, recursiveFileLookup=True)
    place = [] if whole else [F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row")]
    each = with_files(rows.select(F.col("_metadata.file_path").alias("path"), "value", *place), rows, name)
    return each.select("folder", "file_name", "value", *([] if whole else [F.struct("part", "split", "row").alias("line")]))


def read_packed(spark: SparkSession, root: str, name: str) -> DataFrame:
    """folder, file_name, value of the whole files in a pack of ``write_packed`` whose name matches a pattern."""
    rows = spark.read.schema("folder string, name string, value string").parquet(root)
    return rows.select("folder", F.col("name").alias("file_name"), "value").where(F.col("file_name").rlike(name))


def write_packed(rows: DataFrame, root: str) -> None:
    """Writes rows of folder, name and value (a whole text) as a pack: a table with a row per file. Files that are many and
    small cost a request each to write, to list and to read; in a pack they cost their bytes."""
    rows.select("folder", "name", "value").write.parquet(root)


def write_named(rows: DataFrame, root: str, *order: str) -> None:
    """Writes rows of folder, name and value (a line or a whole text), one file for each name of a folder, its lines in order."""
    write_sorted(rows.select("folder", "name", *order, "value").repartition("folder", "name"), root, *order)


def write_lines(rows: DataFrame, root: str, value: Column, *order: Column) -> None:
    """Writes a line ``value`` for each row, beside the columns folder and name, in compressed part files of bounded size that
    make up one file for each name of a folder, its lines in order.

    Order and line are worked out where the file is written: only the columns of ``rows`` are sent and sorted.
    """
    keys = {f"order_{i}": c for i, c in enumerate(order)}
    sorted_ = rows.repartition("folder", "name").withColumns(keys).sortWithinPartitions("folder", "name", *keys)
    lines = sorted_.select("folder", "name", value.alias("value"))
    lines.write.partitionBy("folder", "name").option("maxRecordsPerFile", PART_LINES).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(root)


def write_sorted(rows: DataFrame, root: str, *order: str) -> None:
    """As ``write_named``, for rows whose names are in one partition each."""
    rows.sortWithinPartitions("folder", "name", *order).drop(*order).write.partitionBy("folder", "name").text(root)
