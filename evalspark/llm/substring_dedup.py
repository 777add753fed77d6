"""Substring dedup by super-k-mers: removes words of windows that already start in a document with a smaller id.

A window is ``window`` consecutive words. Its minimiser is the smallest hash of ``mer`` consecutive words in it;
consecutive windows of a document with one minimiser form a super-k-mer. Equal windows have equal minimisers, so:

1. every document yields one small row per super-k-mer (minimiser, 128-bit digest, place); minimisers seen in one
   document only are done;
2. of equal super-k-mers the one in the smallest document owns the words, all others are removed as a whole;
3. the owners travel as packed strings to the bucket of their minimiser, where their windows are sorted and every
   window gets the smallest document that holds it;
4. buckets with more than ``bucket_rows`` owners are not sorted in one place: their windows are dealt out one by one
   and aggregated by content, which gives the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import U64, Scratch, hash_words, join_hashes, mix, offsets_of, slices, texts_of


#: What tells rows apart: the id, and a hash of the text for several rows with one id.
KEY = ["doc_id", "version"]


@dataclass(frozen=True)
class SubstringDedup:
    window: int = 50
    mer: int = 16
    #: Windows of one super-k-mer at most; a longer run is cut, which changes nothing in the result.
    run: int = 256
    #: Owners that one bucket sorts in one place.
    bucket_rows: int = 20_000
    #: Windows that a task sorts at a time.
    sort_windows: int = 1 << 19


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` hashes, by doubling (the runs may cross documents)."""
    out, done, power, span = None, 0, h, 1
    n = len(h) - width + 1
    while span <= width:
        if width & span:
            part = power[done : done + n]
            out = part if out is None else join_hashes(out, part)
            done += span
        if span * 2 <= width:
            power = join_hashes(power[:-span], power[span:])
        span *= 2
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def digests(h: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit polynomial hashes of h[start : start + length], from prefix sums modulo 2^64."""
    out = []
    for base in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
        powers = np.cumprod(np.concatenate([np.ones(1, U64), np.full(len(h), base, U64)]))
        inverse = np.cumprod(np.concatenate([np.ones(1, U64), np.full(len(h), pow(base, -1, 2**64), U64)]))
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(h ^ U64(base)) * powers[:-1])])
        out.append(mix((sums[starts + lengths] - sums[starts]) * inverse[starts] + lengths.astype(U64)))
    return out[0], out[1]


def super_kmers(docs: DataFrame, p: SubstringDedup) -> DataFrame:
    """minimiser, digest (a, b), doc_id, version, first word and number of windows of each super-k-mer."""
    names = ["minimiser", "a", "b", "doc_id", "version", "at", "windows"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            parts = [t.split() for t in texts_of(batch)]
            n = np.fromiter(map(len, parts), np.int64, len(parts))
            h = hash_words([w for q in parts for w in q])
            if len(h) < p.window:
                continue
            doc, base = np.repeat(np.arange(len(parts)), n), offsets_of(n)
            low = sliding_min(rolling(h, p.mer), p.window - p.mer + 1)
            windows = np.flatnonzero(doc[: len(low)] == doc[p.window - 1 :])
            if not len(windows):
                continue
            m, d = low[windows], doc[windows]
            first = np.ones(len(windows), bool)
            first[1:] = (m[1:] != m[:-1]) | (d[1:] != d[:-1])
            heads = np.flatnonzero(first)
            since = np.arange(len(windows)) - np.repeat(heads, np.diff(np.append(heads, len(windows))))
            heads = np.flatnonzero(since % p.run == 0)
            count = np.diff(np.append(heads, len(windows)))
            start = windows[heads]
            a, b = digests(h, start, count + p.window - 1)
            ids, versions = (batch.column(c).to_numpy()[d[heads]] for c in ("doc_id", "version"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (m[heads].view(np.int64), a.view(np.int64), b.view(np.int64), ids, versions, start - base[d[heads]], count)], names=names
            )

    return docs.where("doc_id is not null and text is not null").select("doc_id", "version", "text").mapInArrow(run, ", ".join(f"{x} long" for x in names))


def packed(docs: DataFrame, places: DataFrame) -> DataFrame:
    """The owners' words, cut out of their documents: one string per super-k-mer.

    ``places`` holds the owned super-k-mers of one document as an array, which is no longer than the document. Equal
    rows are cut once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["minimiser", "hot", *KEY, "at", "words"]
        for batch in slices(batches):
            out: list[tuple] = []
            for doc, version, text, owned in zip(*(batch.column(c).to_pylist() for c in KEY), texts_of(batch), batch.column("owned").to_pylist(), strict=True):
                w = text.split()
                out += [(x["minimiser"], x["hot"], doc, version, x["at"], b" ".join(w[x["at"] : x["at"] + x["size"]])) for x in owned]
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return docs.join(places, KEY).dropDuplicates(KEY).mapInArrow(run, "minimiser long, hot boolean, doc_id long, version long, at long, words binary")


def window_rows(table: pa.Table, p: SubstringDedup) -> dict[str, np.ndarray]:
    """Every window of the packed strings: 128-bit digest of its words, document, place."""
    parts = [x.split(b" ") for x in table.column("words").to_pylist()]
    n = np.fromiter(map(len, parts), np.int64, len(parts))
    h = hash_words([w for q in parts for w in q])
    row = np.repeat(np.arange(len(parts)), n)
    start = np.flatnonzero(row[: len(h) - p.window + 1] == row[p.window - 1 :])
    a, b = digests(h, start, np.full(len(start), p.window))
    r = row[start]
    doc, version, at = (table.column(c).to_numpy() for c in (*KEY, "at"))
    return {"a": a.view(np.int64), "b": b.view(np.int64), "doc_id": doc[r], "version": version[r], "at": at[r] + start - offsets_of(n)[r]}


def sorted_windows(strings: DataFrame, p: SubstringDedup) -> DataFrame:
    """doc_id, version, at of the windows that a smaller document of the same bucket holds too.

    A partition holds whole buckets in order; a task sorts as many buckets as fit ``sort_windows``.
    """

    def marks(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        w = window_rows(pa.Table.from_batches(rows), p)
        order = np.lexsort((w["doc_id"], w["b"], w["a"]))
        a, b, doc = w["a"][order], w["b"][order], w["doc_id"][order]
        first = np.ones(len(order), bool)
        first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        owner = doc[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
        hit = order[owner < doc]
        return pa.RecordBatch.from_arrays([pa.array(w[c][hit], pa.int64()) for c in (*KEY, "at")], names=[*KEY, "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            key = batch.column("minimiser").to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1), batch.num_rows]
            length = pc.binary_length(batch.column("words")).to_numpy().astype(np.int64)
            sums = offsets_of(length // 6)
            if held and held[-1].column("minimiser")[-1].as_py() != key[0] and size >= p.sort_windows:
                yield marks(held)
                held, size = [], 0
            at = 0
            for cut in cuts[1:-1]:
                if size + sums[cut] - sums[at] >= p.sort_windows:
                    yield marks([*held, batch.slice(at, cut - at)])
                    held, size, at = [], 0, cut
            held.append(batch.slice(at))
            size += sums[-1] - sums[at]
        if held:
            yield marks(held)

    return strings.mapInArrow(run, "doc_id long, version long, at long")


def dealt_windows(strings: DataFrame, p: SubstringDedup) -> DataFrame:
    """The same for hot buckets, window by window: the smallest document of equal windows by a partial min."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "words"):
            w = window_rows(pa.Table.from_batches([batch]), p)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in w.values()], names=list(w))

    rows = strings.mapInArrow(run, "a long, b long, doc_id long, version long, at long")
    owner = rows.groupBy("a", "b").agg(F.min("doc_id").alias("owner"))
    return rows.join(owner, ["a", "b"]).where("doc_id > owner").select(*KEY, "at")


def removed_ranges(docs: DataFrame, p: SubstringDedup, scratch: Scratch) -> DataFrame:
    """doc_id, version, ranges: arrays of (first window, number of windows) to remove."""
    found = scratch.save(super_kmers(docs, p), "superkmers")
    shared = found.groupBy("minimiser").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("minimiser")
    here = scratch.save(found.join(shared, "minimiser", "left_semi"), "shared")
    owner = here.groupBy("minimiser", "a", "b").agg(F.min("doc_id").alias("owner"))
    ranked = scratch.save(here.join(owner, ["minimiser", "a", "b"]).select("minimiser", *KEY, "at", "windows", "owner"), "owners")
    scratch.drop(found, here)
    whole = ranked.where("doc_id > owner").select(*KEY, "at", "windows")
    owned = ranked.where("doc_id = owner").drop("owner")
    buckets = owned.groupBy("minimiser").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("rows"))
    buckets = buckets.where("lo < hi").select("minimiser", (F.col("rows") > p.bucket_rows).alias("hot"))
    item = F.struct("minimiser", "hot", "at", (F.col("windows") + p.window - 1).alias("size"))
    places = owned.join(buckets, "minimiser").groupBy(*KEY).agg(F.collect_set(item).alias("owned"))
    strings = scratch.save(packed(docs, places), "packed")
    cold = sorted_windows(strings.where("not hot").repartition("minimiser").sortWithinPartitions("minimiser", "doc_id", "at"), p)
    hot = dealt_windows(strings.where("hot").select(*KEY, "at", "words"), p)
    single = cold.union(hot).select(*KEY, "at", F.lit(1).cast("long").alias("windows"))
    return whole.union(single).groupBy(*KEY).agg(F.collect_set(F.struct("at", "windows")).alias("ranges"))


def substring_dedup(docs: DataFrame, params: SubstringDedup = SubstringDedup()) -> DataFrame:
    """doc_id, text, n_words, n_removed, kept_sha256 (of the kept words joined by one space), touched; and ``rest``, the
    struct that ``docs`` may bring along for its caller. A text that loses nothing stays as it is; the kept words of
    others are joined by one space.

    Words are maximal runs without ASCII white space; a null or empty text has none and stays empty. Texts shorter
    than a window lose nothing. Windows repeated inside one document, or in rows with equal doc_id, are kept: only a
    strictly smaller doc_id removes. Each of several rows with one doc_id is judged by its own text. A row without a
    doc_id is neither smaller nor larger than another: it keeps all words and removes none. Other columns are ignored.
    """
    p = params
    scratch = Scratch(docs.sparkSession)
    rest = [c for c in docs.columns if c == "rest"]
    docs = docs.select("doc_id", F.xxhash64("text").alias("version"), "text", *rest)
    ranges = removed_ranges(docs.select(*KEY, "text"), p, scratch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for text, cut in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("ranges"), strict=True):
                words = text.split() if text else []
                gone = 0
                if cut.is_valid:
                    at = cut.values.field("at").to_numpy()
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + cut.values.field("windows").to_numpy() + p.window - 1, -1)
                    stays = np.cumsum(edge[:-1]) == 0
                    gone = len(words) - int(stays.sum())
                    kept = b" ".join([words[i] for i in np.flatnonzero(stays)])
                else:
                    kept = b" ".join(words)
                out.append((None if text is None else kept.decode() if gone else text.decode(), len(words), gone, hashlib.sha256(kept).hexdigest(), gone > 0))
            cols = zip(*out, strict=True)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), *(batch.column(c) for c in rest)],
                names=["doc_id", "text", "n_words", "n_removed", "kept_sha256", "touched", *rest],
            )

    kinds = "doc_id long, text string, n_words long, n_removed long, kept_sha256 string, touched boolean"
    return docs.join(ranges, KEY, "left").mapInArrow(run, kinds + "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in rest))
