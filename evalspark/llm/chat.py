"""Chat formatting over a prefix tree of conversations.

A node of the tree is a prefix of turns; conversations that share their first turns share its nodes. Nodes are found
by a digest of the turns down to them, so merging is a grouping with partial aggregation, however common a first turn
is. The depth-first order is that of the paths of digests, sorted over ranges of whole paths; running sums give every
node its place in the output, where each node's text stands once. Attention of a node: the intervals of its ancestors.

Template of a turn: ``### Role: text</turn>\\n``. Backslashes, ``#`` and ``<`` inside roles and texts get a backslash in
front, so no text can hold a control string and unescaping is exact.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.common import Scratch

HEAD, COLON, TAIL = "### ", ": ", "</turn>\n"
TURN = re.compile(r"### ((?:\\.|[^\\:])*): ((?:\\.|[^\\#<])*)</turn>\n", re.S)
UNESCAPE = re.compile(r"\\(.)", re.S)


@dataclass(frozen=True)
class Chat:
    #: Role whose texts carry the loss.
    loss_role: str = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"([\\#<])", r"\\$1")


def escaped_role(role: Column) -> Column:
    return F.regexp_replace(escaped(role), ":", r"\\:")


def turns_in_order(turns: DataFrame) -> DataFrame:
    """conv_id, depth, node, role, body: every turn with its place, and a digest of all turns down to it.

    Rows of one turn number are ordered by role and text, and equal rows count as often as they occur. The digest is the
    exclusive or of two 64-bit hashes of each turn and its place, so a running aggregate builds it.
    """
    text = lambda c: F.coalesce(c, F.lit("")).alias("body" if c == "text" else c)
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "body")
    rows = turns.select("conv_id", "turn", text("role"), text("text")).withColumn("depth", F.row_number().over(order) - 1)
    half = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "depth", "role", "body")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    node = F.concat(*(F.lpad(F.hex(half(seed)), 16, "0") for seed in (1, 2)))
    return rows.select("conv_id", "depth", node.alias("node"), "role", "body")


def joined(spans: Column) -> Column:
    """Spans (begin, end) in order, those that touch made one."""
    kind = F.array().cast("array<struct<begin:bigint,end:bigint>>")

    def add(done: Column, x: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        longer = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(last["begin"].alias("begin"), x["end"].alias("end"))))
        return F.when(last["end"] == x["begin"], longer).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(spans, kind, add)


def prefix_tree(turns: DataFrame, scratch: Scratch, params: Chat = Chat()) -> tuple[DataFrame, DataFrame]:
    """(nodes, ways).

    nodes: node, parent, depth, conversations, formatted text of the turn, loss span inside it (from, to), begin and
    size in the depth-first output, position of its first character in its conversation, and attention: the
    (begin, end) intervals that its ancestors fill, in order, touching ones made one. ways: conv_id, depth, node.

    Distinct conversations, sorted by their paths of digests over ranges of the whole path, are the leaves in
    depth-first order. A node stands with the first leaf that has it: the nodes of one leaf are one run of the output.
    So running sums over leaves and along each leaf place every node, and what a node attends to is a piece of each run
    above it; a conversation that shares nothing has one interval, however long it is.
    """
    each = scratch.save(turns_in_order(turns), "turns")
    item = F.array_sort(F.collect_list(F.struct("depth", "node")))
    paths = each.groupBy("conv_id").agg(F.transform(item, lambda x: x["node"]).alias("path")).select("path").distinct()
    leaves = scratch.save(paths.orderBy("path").select("path", F.monotonically_increasing_id().alias("leaf")), "leaves")
    parents = F.concat(F.array(F.lit(None).cast("string")), F.slice("path", 1, F.size("path") - 1))
    way = leaves.select("leaf", F.posexplode(F.arrays_zip("path", parents.alias("parents"))).alias("depth", "x"))
    way = scratch.save(way.select("leaf", "depth", F.col("x.path").alias("node"), F.col("x.parents").alias("parent")), "way")
    first = way.groupBy("node").agg(F.min("leaf").alias("leaf"), F.min("parent").alias("parent"))
    head = F.concat(F.lit(HEAD), escaped_role(F.col("role")), F.lit(COLON))
    content = each.groupBy("node", "depth", "role", "body").agg(F.count("*").alias("conversations"))
    content = content.withColumn("head", F.length(head)).withColumn("text", F.concat(head, escaped(F.col("body")), F.lit(TAIL)))
    loss = F.col("role") == params.loss_role
    merged = content.join(first, "node").select(
        "node", "leaf", "parent", "depth", "conversations", "text", F.length("text").cast("long").alias("size"),
        F.when(loss, F.col("head")).alias("loss_from"), F.when(loss, F.length("text") - len(TAIL)).alias("loss_to"),
    )
    merged = scratch.save(merged, "nodes")
    # where the run of each leaf begins: sums over ranges of leaves (the parts of the sort), then inside each range
    span = F.shiftright("leaf", 33).alias("range")
    runs = merged.groupBy("leaf").agg(F.sum("size").alias("chars")).select("leaf", span, "chars")
    before = lambda w: F.coalesce(F.sum("chars").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tops = runs.groupBy("range").agg(F.sum("chars").alias("chars"))
    tops = tops.select("range", before(Window.orderBy("range")).alias("top"))
    runs = runs.withColumn("mid", before(Window.partitionBy("range").orderBy("leaf"))).join(tops, "range").select("leaf", (F.col("mid") + F.col("top")).alias("start"))
    ahead = F.coalesce(F.sum("size").over(Window.partitionBy("leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = merged.withColumn("ahead", ahead).join(runs, "leaf").withColumn("begin", F.col("start") + F.col("ahead"))
    placed = scratch.save(placed, "placed")
    # the pieces of other leaves' runs above each run
    above = way.join(placed.select("node", F.col("leaf").alias("of"), "begin", "size"), "node").where("of <> leaf")
    pieces = above.groupBy("leaf", "of").agg(F.min("begin").alias("begin"), F.max(F.col("begin") + F.col("size")).alias("end"))
    shared = pieces.groupBy("leaf").agg(joined(F.array_sort(F.collect_list(F.struct("begin", "end")))).alias("above"), F.sum(F.col("end") - F.col("begin")).alias("chars_above"))
    own = F.when(F.col("ahead") > 0, F.array(F.struct(F.col("start").alias("begin"), F.col("begin").alias("end")))).otherwise(F.array().cast("array<struct<begin:bigint,end:bigint>>"))
    before_run = F.coalesce("above", F.array().cast("array<struct<begin:bigint,end:bigint>>"))
    nodes = placed.join(shared, "leaf", "left").withColumns({"attention": joined(F.concat(before_run, own)), "position": F.coalesce("chars_above", F.lit(0)) + F.col("ahead")})
    return nodes.drop("leaf", "start", "ahead", "above", "chars_above"), each.select("conv_id", "depth", "node")


def unescape(s: str) -> str:
    return UNESCAPE.sub(r"\1", s)


def read_back(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """Per conversation, from the output alone: roles, texts, loss text, and lengths.

    Every conversation gathers the nodes that its last turn attends to, in order, and parses the template; a part that
    is not a turn, or a position or interval that does not fit, is an error.
    """
    way = ways.select("conv_id", F.col("depth").alias("at"), "node")
    parts = way.join(nodes.select("node", "text", "loss_from", "loss_to", "begin", "size", "position", "attention"), "node")
    item = F.struct("at", "text", "loss_from", "loss_to", "begin", "size", "position", "attention")
    per = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts in batch.column("parts").to_pylist():
                digest, masked, chars, size, at, seen = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, []
                for x in parts:
                    m = TURN.fullmatch(x["text"])
                    if not m or x["position"] != at or [(a["begin"], a["end"]) for a in x["attention"]] != seen:
                        raise ValueError(f"a broken node: {x['text'][:80]!r}")
                    role, text = unescape(m[1]), unescape(m[2])
                    digest.update(f"{role}\n{text}\n".encode())
                    if x["loss_from"] is not None:
                        under = unescape(x["text"][x["loss_from"] : x["loss_to"]])
                        masked.update(under.encode())
                        chars += len(under)
                    size += len(x["text"])
                    at += x["size"]
                    begin = seen.pop()[0] if seen and seen[-1][1] == x["begin"] else x["begin"]
                    seen.append((begin, x["begin"] + x["size"]))
                out.append((len(parts), digest.hexdigest(), chars, masked.hexdigest(), size))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            )

    return per.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def formatted(turns: DataFrame, params: Chat = Chat()) -> DataFrame:
    """conv_id and what is read back from the tree's output.

    ``turns``: conv_id, turn, role, text. Null roles and texts are empty strings; null turns come first. Extra columns
    are ignored; an empty table gives no rows.
    """
    scratch = Scratch(turns.sparkSession)
    nodes, ways = prefix_tree(turns.select("conv_id", "turn", "role", "text"), scratch, params)
    return read_back(scratch.save(nodes, "tree"), ways)
