"""Shared helpers: scratch tables on the shared folder, batch slicing and word hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalspark.sources.tables import delete, scratch_dir

#: Text bytes that one numpy step of a task works on; a longer document is a step of its own.
SLICE_BYTES = 2 << 20
WORD = r"[^\x20\x09-\x0D]+"
U64 = np.uint64


class Scratch:
    """Tables written under the shared folder, so that they outlive executors and cut lineage."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{scratch_dir(spark)}/evalspark-{uuid.uuid4().hex}", 0

    def save(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables that nothing still reads."""
        for df in frames:
            delete(self.spark, df.scratch_path)


@contextmanager
def batch_bytes(spark: SparkSession, size: int) -> Iterator[None]:
    """Tables written meanwhile send Python batches of at most ``size`` bytes (one row at least), where rows are wide."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches into runs of rows with at most ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of each row; null becomes empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (the constants of SplitMix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def join_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-dependent hash of two hashes."""
    return mix(a * U64(0x9E3779B97F4A7C15) + (b ^ (b >> U64(32))) + U64(0x632BE59BD9B4E019))


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths, dtype=np.int64)])


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), pa.int32()), pa.array(values, kind))


def code_points(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in one array, and each text's offset."""
    raw = b"".join(texts)
    heads = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    at = offsets_of(np.fromiter(map(len, texts), np.int64, len(texts)))
    return np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32), np.concatenate([np.zeros(1, np.int64), np.cumsum(heads)])[at]


_TABLES: dict[str, np.ndarray] = {}


def letter_table() -> np.ndarray:
    """For each code point its lower-case letter, or a space where it is no letter."""
    if "letter" not in _TABLES:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _TABLES["letter"] = table
    return _TABLES["letter"]


def held_out() -> Column:
    """The fold that no model learns from; rows without a doc_id belong to it."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(True))


def hash_share(share: float, column: str = "doc_id", seed: int = 11) -> Column:
    """A reproducible share of the rows, by the hash of their id."""
    return F.pmod(F.xxhash64(column, F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, balanced: bool = False, chars: int = 1 << 26) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, label of about ``rows`` labelled documents, by hash; all labelled ids by label value).

    An id labelled more than once has the label of most of its rows (1 in a tie). Labels are cut first, so only a table
    of about ``rows`` ids and labels is broadcast and no text is shuffled. Equal rows are one. The sample is taken in
    the order of a hash until it holds ``chars`` code points, and written once for the passes that training makes.
    ``balanced``: as many rows of each value.
    """
    used = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg(F.col(label)) >= 0.5).cast("long").alias(label)).where(F.col(label).isNotNull())
    per = {r[label]: r["count"] for r in used.groupBy(label).count().collect()}
    total, pick = sum(per.values()), F.lit(False)
    for value, n in per.items():
        pick = pick | ((F.col(label) == value) & hash_share(min(1.0, rows / len(per) / n if balanced else rows / total)))
    scratch = Scratch(docs.sparkSession)
    found = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(used.where(pick)), "doc_id").dropDuplicates(["doc_id", "text"])
    found = scratch.save(found.withColumns({"order": F.xxhash64("doc_id", "text"), "length": F.length("text")}), "labelled")
    # the hash up to which the sample keeps to its code points: of a few thousand lengths
    so_far = F.sum("length").over(Window.orderBy("order", "doc_id")) - F.col("length")
    last = found.select("order", so_far.alias("before")).where(F.col("before") < chars).agg(F.max("order")).first()[0]
    return found.where(F.col("order") <= F.lit(last)).drop("length"), per


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Logistic regression with an intercept (first weight) by Newton steps; for a few dense columns."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-9, *[l2 * len(x)] * (x.shape[1] - 1)])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w
