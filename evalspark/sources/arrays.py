"""JSON arrays of a file each, read and written by elements, so that no row holds a whole file."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalspark.sources.files import file_names, named, write_sorted
from evalspark.sources.tables import Tables

#: Rows of the table of splits up to which it is broadcast; beyond, the engine decides by its size.
BROADCAST_ROWS = 100_000


def opened(text: Column) -> Column:
    """Brackets opened less brackets closed."""
    return F.length(F.translate(text, "]}", "")) - F.length(F.translate(text, "[{", ""))


def read_arrays(spark: SparkSession, root: str, name: str) -> DataFrame:
    """folder, file_name, ord (place from 0) and value (JSON text) of the elements of arrays in files whose name matches.

    Splits of a file are read by different tasks, cut at every comma. Whether a comma stands in a string or deep in an
    element depends on all that comes before it, so each split keeps both cases: what it does to quotes and brackets if
    it begins outside of a string, and if inside. A small table of splits then tells which case holds and how deep each
    begins; commas outside of strings at depth one part the elements, and pieces of one element are put together.

    A file that is no array, or is broken anywhere, has no elements, as has an empty array.
    """
    tables = Tables(spark)
    place = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row")]
    rows = spark.read.text(root, lineSep=",", recursiveFileLookup=True)
    rows = rows.where(named(F.col("_metadata.file_path"))[1].rlike(name)).select(*place, "value")

    # A comma of valid JSON is never escaped, so a piece holds its escapes whole. Most pieces have no escape and no bracket.
    bare = F.when(F.contains("value", F.lit("\\")), F.regexp_replace("value", r"(?s)\\.", "")).otherwise(F.col("value"))
    rows = rows.withColumn("bare", bare).withColumn("flat", F.translate("bare", "[]{}", "") == F.col("bare"))
    strings = r'"[^"]*("|\z)'
    outside = opened(F.regexp_replace("bare", strings, ""))
    inside = opened(F.regexp_replace(F.regexp_replace("bare", r'^[^"]*("|\z)', ""), strings, ""))
    outside, inside = (F.when(F.col("flat"), 0).otherwise(x) for x in (outside, inside))
    of_split = Window.partitionBy("path", "split").orderBy("row")
    so_far, before = (of_split.rowsBetween(Window.unboundedPreceding, end) for end in (0, -1))
    rows = rows.withColumns({"quotes": F.length("bare") - F.length(F.translate("bare", '"', "")), "outside": outside, "inside": inside}).drop("bare", "flat")
    rows = rows.withColumn("odd", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    rows = rows.withColumns({
        "depth_0": F.sum(F.when(F.col("odd") == 0, F.col("outside")).otherwise(F.col("inside"))).over(so_far),
        "depth_1": F.sum(F.when(F.col("odd") == 1, F.col("outside")).otherwise(F.col("inside"))).over(so_far),
        "odd": (F.col("odd") + F.col("quotes")) % 2,
    })
    pieces = tables.save(rows.drop("quotes", "outside", "inside"), "pieces")

    of_file = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    ahead = lambda c: F.coalesce(F.sum(c).over(of_file), F.lit(0))
    splits = pieces.groupBy("path", "split").agg(F.max_by(F.struct("odd", "depth_0", "depth_1"), "row").alias("x")).select("path", "split", "x.*")
    splits = splits.withColumn("case", ahead("odd") % 2)
    splits = splits.withColumn("depth", F.when(F.col("case") == 1, F.col("depth_1")).otherwise(F.col("depth_0")))
    splits = splits.select("path", "split", "case", ahead("depth").alias("begin"), ((F.col("case") + F.col("odd")) % 2).alias("open"), "depth")
    splits = tables.save(splits, "splits")

    def beside(small: DataFrame) -> DataFrame:
        return F.broadcast(small) if splits.count() <= BROADCAST_ROWS else small

    level = F.col("begin") + F.when(F.col("case") == 1, F.col("depth_1")).otherwise(F.col("depth_0"))
    ends = ((level == 1) & ((F.col("case") + F.col("odd")) % 2 == 0)).cast("long")
    known = pieces.join(beside(splits.select("path", "split", "case", "begin")), ["path", "split"]).withColumn("ends", ends)
    per = known.groupBy("path", "split").agg(F.sum("ends").alias("n")).select("path", "split", "n", ahead("n").alias("first"))
    per = tables.save(per, "counts")
    files = per.groupBy("path").agg(F.sum("n").alias("last")).join(
        splits.groupBy("path").agg((F.sum("depth") == 0).alias("closed"), (F.max_by("open", "split") == 0).alias("ended")), "path"
    )

    numbered = known.withColumn("ord", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    numbered = numbered.join(beside(per.select("path", "split", "first")), ["path", "split"]).withColumn("ord", F.col("ord") + F.col("first"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("split", "row", "value"))), lambda x: x["value"]), ",")
    folder, file_name = named(F.col("path"))
    each = numbered.groupBy("path", "ord").agg(whole.alias("value")).join(beside(files), "path").withColumns({"folder": folder, "file_name": file_name})

    each = tables.save(checked(each), "elements")
    tables.drop(pieces, splits, per)
    return whole_files(each, each.where("not good").select("path"))


def checked(each: DataFrame) -> DataFrame:
    """Elements without their file's brackets, and whether they are ``good``: framed by these, and one JSON value."""
    head, tail = r"^\x{FEFF}?\s*\[", r"\]\s*\z"
    first, last = F.col("ord") == 0, F.col("ord") == F.col("last")
    framed = F.col("closed") & F.col("ended") & (~first | F.col("value").rlike(head)) & (~last | F.col("value").rlike(tail))
    each = each.withColumn("framed", framed)
    each = each.withColumn("value", F.when(first, F.regexp_replace("value", head, "")).otherwise(F.col("value")))
    each = each.withColumn("value", F.when(last, F.regexp_replace("value", tail, "")).otherwise(F.col("value")))
    empty = first & last & F.col("value").rlike(r"^\s*\z")
    # The parser stops after one value; with a second one behind it, nothing else can stand between.
    alone = F.is_variant_null(F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), "value", F.lit(",null]"))), "$[1]", "variant"))
    each = each.withColumns({"empty": empty, "good": F.col("framed") & (empty | F.coalesce(alone, F.lit(False)))})
    return each.select("path", "folder", "file_name", "ord", "value", "empty", "good")


def whole_files(each: DataFrame, broken: DataFrame) -> DataFrame:
    good = each.where("not empty").join(broken.distinct(), "path", "left_anti")
    return good.select("folder", "file_name", "ord", F.btrim("value", F.lit(" \t\r\n")).alias("value"))


BRACKETS = np.zeros(256, np.int8)
BRACKETS[[91, 123]], BRACKETS[[93, 125]] = 1, -1
#: A member of an object without escapes, with a number.
PLAIN = r'^[ \t\r\n]*"(?P<key>[^"\\\x00-\x1f]*)"[ \t\r\n]*:[ \t\r\n]*(?P<number>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)[ \t\r\n]*$'
#: Depth of the members of an object in a field of an element.
INNER = 3


@dataclass
class Marks:
    """Of some pieces: their text without escaped characters, where each ends, how many quotes come before that, and the
    brackets with 1 or -1 and the quotes before them."""

    text: np.ndarray
    ends: np.ndarray
    quotes: np.ndarray
    at: np.ndarray
    sign: np.ndarray
    before: np.ndarray

    @classmethod
    def of(cls, values: pa.Array) -> Marks:
        values = values.cast(pa.large_binary())
        offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
        data = values.buffers()[2]
        text = (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]]
        ends = offsets[1:] - offsets[0]
        back = np.flatnonzero(text == 92)
        if len(back):
            piece = np.searchsorted(ends, back, "right")
            first = np.r_[True, (np.diff(back) != 1) | (np.diff(piece) != 0)]
            run = back[np.maximum.accumulate(np.where(first, np.arange(len(back)), 0))]
            after = back[(back - run) % 2 == 0] + 1
            text = text.copy()
            text[after[~np.isin(after, ends)]] = 32
        quote, at = np.flatnonzero(text == 34), np.flatnonzero(BRACKETS[text])
        return cls(text, ends, np.searchsorted(quote, ends), at, BRACKETS[text[at]].astype(np.int64), np.searchsorted(quote, at))

    def outside(self, inside: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of brackets outside of strings: place, 1 or -1, depth behind them. Of pieces: depth behind them, and whether a
        string goes on. ``inside``, ``depth``: as the first begins."""
        out = (inside + self.before) % 2 == 0
        at, sign = self.at[out], self.sign[out]
        total = np.r_[0, np.cumsum(sign)] + depth
        return at, sign, total[1:], total[np.searchsorted(at, self.ends)], (inside + self.quotes) % 2 == 1

    def opens(self, at: int, field: str) -> bool:
        """Whether the bracket begins an object in a field whose name ends so. A name with a comma is not seen."""
        k = np.searchsorted(self.ends, at, "right")
        head = self.text[self.ends[k - 1] if k else 0 : at].tobytes()
        found = re.search(rb'"([^"]*)"\s*:\s*\Z', head)
        return bool(self.text[at] == 123 and found and found[1].endswith(field.encode()))


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.Array]]:
    """((file, split), values) of rows in the order that they are read in."""
    for batch in batches:
        file, split = batch.column("file").to_numpy(), batch.column("split").to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(file) != 0) | (np.diff(split) != 0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a < b:
                yield (int(file[a]), int(split[a])), batch.column("value").slice(a, b - a)


def read_objects(spark: SparkSession, root: str, name: str, field: str) -> tuple[DataFrame, DataFrame]:
    """(elements as ``read_arrays`` gives them, entries: folder, file_name, ord, key, number): arrays of objects, and the
    members of an object in a field whose name ends in ``field`` as rows, so that no row holds that object.

    Elements keep its first and last member, which are entries too. A key that an object has twice gives two entries.

    Files are read twice. First each split tells, for both cases of its beginning (outside of a string, or inside), what
    it does to quotes and depth, how many of its commas stand at which depth, and whether the last bracket that opened
    each depth begins such an object. A walk over the splits then knows how each begins, and the second time every
    piece has its place where it is read; only pieces of elements are put together.
    """
    tables = Tables(spark)
    rows = spark.read.text(root, lineSep=",", recursiveFileLookup=True)
    listed = file_names(rows, name)
    files = listed.collect()
    number = {r["path"]: i for i, r in enumerate(files)}
    numbers = spark.createDataFrame(pa.table({"path": pa.array(list(number), pa.string()), "file": pa.array(number.values(), pa.int64())}))
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), "value")
    rows = rows.join(F.broadcast(numbers), "path").select("file", "split", "value")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = None, []
        for key, values in runs(batches):
            if key != now:
                now, quotes, depth = key, 0, [0, 0]
                commas, opened = ({}, {}), ({}, {})
                seen.append((key, commas, opened, depth, parity := [0]))
            marks = Marks.of(values)
            for case in (0, 1):
                at, sign, behind, level, open_ = marks.outside((case + quotes) % 2, depth[case])
                for k, n in zip(*np.unique(level[~open_], return_counts=True), strict=True):
                    commas[case][int(k)] = commas[case].get(int(k), 0) + int(n)
                up = np.flatnonzero(sign > 0)
                for k in np.unique(behind[up]):
                    opened[case][int(k)] = marks.opens(at[up[behind[up] == k][-1]], field)
                depth[case] = int(behind[-1]) if len(behind) else depth[case]
            quotes = parity[0] = (quotes + int(marks.quotes[-1])) % 2
        for (file, split), commas, opened, depth, parity in seen:
            say = json.dumps([[list(x.items()) for x in commas], [list(x.items()) for x in opened], depth, parity[0]])
            yield pa.RecordBatch.from_pydict({"file": [file], "split": [split], "say": [say]})

    begins, wholes, at = {}, {}, None
    for r in sorted(rows.mapInArrow(told, "file long, split long, say string").collect()):  # a row per split
        if r["file"] != at:
            at, case, depth, place, inner = r["file"], 0, 0, 0, False
        begins[(at, r["split"])] = (case, depth, place, inner)
        commas, opened, change, odd = json.loads(r["say"])
        place += dict(commas[case]).get(1 - depth, 0)
        inner = dict(opened[case]).get(INNER - depth, inner)
        depth, case = depth + change[case], (case + odd) % 2
        wholes[at] = (place, depth == 0, case == 0)
    known = spark.sparkContext.broadcast(begins)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, row = None, 0
        for key, values in runs(batches):
            if key != now:
                now, (case, depth, place, inner), row = key, known.value[key], 0
            marks = Marks.of(values)
            at, sign, behind, level, open_ = marks.outside(case, depth)
            ends = ~open_ & (level == 1)
            ords = place + np.r_[0, np.cumsum(ends)]
            up = at[(sign > 0) & (behind == INNER)]
            flags = np.array([inner, *(marks.opens(k, field) for k in up)], bool)
            flag = flags[np.searchsorted(up, marks.ends)]
            bare = np.diff(np.r_[0, np.searchsorted(at, marks.ends)]) == 0
            within = (level == INNER) & ~open_
            member = within & np.r_[depth == INNER and case == 0, within[:-1]] & bare & flag
            plain = pc.extract_regex(values, PLAIN)
            entry = member & plain.is_valid().to_numpy(zero_copy_only=False)
            none = lambda n, kind: pa.nulls(n, kind)
            names = ["file", "ord", "split", "row", "value", "key", "number"]
            n, few = int(entry.sum()), plain.filter(pa.array(entry))
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, key[0])), pa.array(ords[:-1][entry]), none(n, pa.int64()), none(n, pa.int64()), none(n, pa.string()), few.field("key"), few.field("number").cast(pa.float64())], names=names)
            n, rest = int((~entry).sum()), row + np.arange(len(values))
            if n:
                rest = np.where(member, -1, rest)[~entry]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, key[0])), pa.array(ords[:-1][~entry]), pa.array(np.full(n, key[1])), pa.array(rest), values.filter(pa.array(~entry)), none(n, pa.string()), none(n, pa.float64())], names=names)
            row, place, inner = row + len(values), int(ords[-1]), bool(flags[-1])
            depth, case = int(level[-1]), int(open_[-1])

    found = tables.save(rows.mapInArrow(cut, "file long, ord long, split long, row long, value string, key string, number double"), "members")
    of = [(i, files[i]["path"], files[i]["folder"], files[i]["file_name"], *x) for i, x in wholes.items()]
    of = spark.createDataFrame(of, "file long, path string, folder string, file_name string, last long, closed boolean, ended boolean")
    of = F.broadcast(of) if len(wholes) <= BROADCAST_ROWS else of
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("split", "row", "value"))), lambda x: x["value"]), ",")
    each = found.where("row >= 0").groupBy("file", "ord").agg(whole.alias("value")).join(of, "file")
    each = tables.save(checked(each), "elements")
    odd = found.where("row < 0").join(of, "file").withColumn("v", F.try_parse_json(F.concat(F.lit("{"), "value", F.lit("}"))))
    odd = tables.save(odd.select("path", "folder", "file_name", "ord", "v"), "odd")
    broken = tables.save(each.where("not good").select("path").unionByName(odd.where("v is null").select("path")).distinct(), "broken")
    entries = found.where("key is not null").join(of, "file").select("path", "folder", "file_name", "ord", "key", "number")
    rest = odd.select("path", "folder", "file_name", "ord", F.explode(F.try_variant_get("v", "$", "map<string,double>")).alias("key", "number"))
    few = each.where("not empty").withColumn("m", F.try_variant_get(F.try_parse_json("value"), "$", "map<string,variant>"))
    few = few.select("path", "folder", "file_name", "ord", F.explode(F.map_filter("m", lambda k, x: F.endswith(k, F.lit(field)))).alias("name", "x"))
    few = few.select("path", "folder", "file_name", "ord", F.explode(F.try_variant_get("x", "$", "map<string,double>")).alias("key", "number"))
    entries = entries.unionByName(rest).unionByName(few)
    if not broken.isEmpty():
        entries = entries.join(broken, "path", "left_anti")
    return whole_files(each, broken), entries.drop("path")


def write_arrays(rows: DataFrame, root: str, *order: str, field: str = "", entries: DataFrame | None = None, within: Sequence[str] = ()) -> None:
    """Writes rows of folder, name and value (JSON text) as an array for each name of a folder, in order, an element a
    line. Rows stream to their file; a name without rows has no file.

    ``entries``: folder, name, the columns of order and of ``within``, and value, such as "a":1. They become an object in a
    field more of their element, itself an object, an entry a line, so that no row holds an element. Elements then differ
    in their order, each has the field, and an entry without an element is an error.
    """
    of_name = Window.partitionBy("folder", "name").orderBy(*order)
    begin = F.when(F.row_number().over(of_name) == 1, "[").otherwise("")
    end = F.when(F.lead(F.lit(1)).over(of_name).isNull(), "]").otherwise(",")
    if entries is None:
        lines = rows.select("folder", "name", F.concat(begin, "value", end).alias("value"), F.row_number().over(of_name).alias("line"))
        return write_sorted(lines, root, "line")
    keys = ["folder", "name", *order]
    head = F.concat(F.when(F.col("value") == "{}", "{").otherwise(F.concat(F.regexp_replace("value", r"\}$", ""), F.lit(","))), F.lit(f"{json.dumps(field)}:{{"))
    ends = rows.select(*keys, F.concat(begin, head).alias("head"), F.concat(F.lit("}}"), end).alias("tail"))
    ends = ends.select(*keys, F.explode(F.create_map(F.lit(0), "head", F.lit(2), "tail")).alias("part", "value"))
    lines = ends.unionByName(entries.select(*keys, F.lit(1).alias("part"), *within, "value"), allowMissingColumns=True)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("part", *within))
    lines = lines.repartition("folder", "name").withColumn("place", place)
    alone = F.when((F.col("place") == 1) != (F.col("part") == 0), F.raise_error(F.lit("an entry without an element, or two elements of one order")).cast("string"))
    value = F.coalesce(alone, F.concat(F.when((F.col("part") == 1) & (F.col("place") > 2), ",").otherwise(""), "value"))
    write_sorted(lines.withColumn("value", value).drop("place"), root, *order, "part", *within)
