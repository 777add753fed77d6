"""Prefix trie of conversations by the Euler-tour technique.

A node is a distinct sequence of first turns. Nodes are found by a running digest of the turns, so merging is a grouping
with partial aggregation. Every node has an enter and an exit arc; the tour that links them in depth-first order is a
list, which is ranked distributedly: rounds of splicing out local minima of a hash, whose sums their successors take
over, then the same rounds backwards. A subtree is what stands between a node's two arcs, so its leaves and savings are
differences of prefix sums.

Neither the turns of a conversation nor the children of a node are ever in one task as a whole: turns have their places
from a range sort and sums per range, digests run over chunks of turns, siblings are linked in buckets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.common import Scratch, batch_bytes

#: Turns of a conversation whose digests one window task runs over.
CHUNK_BITS = 10


@dataclass(frozen=True)
class Trie:
    #: Conversations share turns with the first one of this many.
    group: int = 5
    #: A conversation shares up to this many turns, less one.
    shared: int = 9
    #: Nodes per bucket of siblings, on average.
    bucket: int = 65_536
    #: Arcs that one task ranks by walking; longer lists are contracted first.
    base: int = 16_384


def seeded(seed: int, *columns: str | Column) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def before(column: str, window) -> Column:
    """Sum of the rows before, 0 for the first."""
    return F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def turns_in_order(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, part, at, a, b, bytes: every turn with its range and place in the order, two hashes and its text's length.

    Rows of one turn number are ordered by role and text. Rows without a conv_id belong to no conversation and go.
    """
    filled = lambda c: F.coalesce(c, F.lit("")).alias(f"{c}_")
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", filled("role"), filled("text"))
    rows = rows.orderBy("conv_id", F.asc_nulls_first("turn"), "role_", "text_")
    rows = rows.select("conv_id", F.monotonically_increasing_id().alias("at"), seeded(1, "role_", "text_").alias("a"), seeded(2, "role_", "text_").alias("b"), F.octet_length("text_").cast("long").alias("bytes"))
    return scratch.save(rows.withColumn("part", F.shiftright("at", 33)), "turns")


def rebuilt(turns: DataFrame, scratch: Scratch, params: Trie) -> tuple[DataFrame, DataFrame]:
    """(conversations: conv_id, length; turns: conv_id, pos, length, a, b, bytes) after sharing first turns.

    Conversation c begins with the first h turns of conversation c - c % group (all if fewer, none if absent), h being
    the CRC-32 of its number modulo ``shared``; its own turns after its first h follow.
    """
    spans = turns.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    spans = spans.withColumn("ahead", before("n", Window.partitionBy("conv_id").orderBy("part")))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % params.shared
    each = spans.groupBy("conv_id").agg(F.sum("n").alias("n")).withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % params.group})
    given = each.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    each = each.join(given, "base", "left").withColumn("given", F.least("h", F.coalesce("n_base", F.lit(0))))
    each = scratch.save(each.withColumn("length", F.col("given") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).select("conv_id", "base", "h", "given", "length"), "conversations")
    placed = turns.join(spans.select("conv_id", "part", "first", "ahead"), ["conv_id", "part"])
    placed = placed.select("conv_id", "part", (F.col("at") - F.col("first") + F.col("ahead")).alias("pos"), "a", "b", "bytes")
    placed = scratch.save(placed, "placed")
    # rows of one conversation and range meet one row that says where its own turns begin
    starts = spans.select("conv_id", "part").join(each.select("conv_id", "h", "given", "length"), "conv_id")
    own = placed.join(starts, ["conv_id", "part"]).where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("given")).alias("pos"), "length", "a", "b", "bytes")
    lent = placed.where(F.col("pos") < params.shared).select(F.col("conv_id").alias("base"), "pos", "a", "b", "bytes")
    lent = lent.join(each.select("base", "conv_id", "h", "length"), "base").where("pos < h").select("conv_id", "pos", "length", "a", "b", "bytes")
    return each.select("conv_id", "length"), own.unionByName(lent)


def with_digests(turns: DataFrame) -> DataFrame:
    """conv_id, pos, n1, n2 (digest of all turns down to this one), p1, p2 (of those before it), bytes, last.

    A digest is the exclusive or of hashes of each turn with its place: chunks of turns on their own, then chunk by chunk.
    """
    kinds = {k: seeded(s, "pos", "a", "b") for k, s in (("k1", 3), ("k2", 4))}
    rows = turns.withColumns(kinds).withColumn("chunk", F.shiftright("pos", CHUNK_BITS))
    per = rows.groupBy("conv_id", "chunk").agg(F.bit_xor("k1").alias("c1"), F.bit_xor("k2").alias("c2"))
    ahead = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("conv_id", "chunk", *(F.coalesce(F.bit_xor(c).over(ahead), F.lit(0)).alias(c) for c in ("c1", "c2")))
    upto = Window.partitionBy("conv_id", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"n{i}": F.bit_xor(f"k{i}").over(upto) for i in (1, 2)}).join(per, ["conv_id", "chunk"])
    rows = rows.withColumns({f"n{i}": F.col(f"n{i}").bitwiseXOR(F.col(f"c{i}")) for i in (1, 2)})
    parents = (F.col(f"n{i}").bitwiseXOR(F.col(f"k{i}")).alias(f"p{i}") for i in (1, 2))
    return rows.select("conv_id", "pos", "n1", "n2", *parents, "bytes", (F.col("pos") + 1 == F.col("length")).alias("last"))


def ranked(links: DataFrame, sums: tuple[str, ...], scratch: Scratch, base: int = 16_384) -> DataFrame:
    """id and the prefix sums (inclusive) of ``sums`` along a linked list: id, prev, next (null at its ends), sums.

    Rounds: an element whose hash is smaller than its neighbours' is spliced out, its sums go to the element after it,
    and it keeps what it was: its predecessor's prefix and its own sums are its prefix, once the predecessor's is known.
    About a third goes in each round, so all rounds together move a few times the list. Each round is one shuffle into a
    table. What is left, ``base`` elements at most, is walked by one task.
    """
    kinds = ", ".join(f"{c} long" for c in sums)
    here, gone, turn = links.select("id", "prev", "next", *sums), [], 0
    while here.count() > base:
        turn += 1
        hashed = lambda c, t=turn: F.xxhash64(F.lit(t), c)
        low = F.col("prev").isNotNull() & (hashed("id") < hashed("prev")) & (F.col("next").isNull() | (hashed("id") < hashed("next")))
        marked = here.withColumn("out", low)
        out = marked.where("out")
        gone.append(scratch.save(out.select("id", "prev", *sums), "spliced"))
        none = F.lit(None).cast("long")
        # a survivor's row, what its removed successor leaves to it, what its removed predecessor leaves to it
        stay = marked.where("not out").select("id", F.struct("prev", "next").alias("own"), none.alias("new_next"), F.lit(False).alias("cut_next"), none.alias("new_prev"), *sums)
        left = out.select(F.col("prev").alias("id"), F.lit(None).cast("struct<prev:bigint,next:bigint>").alias("own"), F.col("next").alias("new_next"), F.lit(True).alias("cut_next"), none.alias("new_prev"), *(F.lit(0).cast("long").alias(c) for c in sums))
        right = out.where("next is not null").select(F.col("next").alias("id"), F.lit(None).cast("struct<prev:bigint,next:bigint>").alias("own"), none.alias("new_next"), F.lit(False).alias("cut_next"), F.col("prev").alias("new_prev"), *sums)
        joined = stay.unionByName(left).unionByName(right).groupBy("id").agg(F.max("own").alias("own"), F.max("new_next").alias("new_next"), F.max("cut_next").alias("cut"), F.max("new_prev").alias("new_prev"), *(F.sum(c).alias(c) for c in sums))
        after = joined.select("id", F.coalesce("new_prev", "own.prev").alias("prev"), F.when(F.col("cut"), F.col("new_next")).otherwise(F.col("own.next")).alias("next"), *sums)
        before_, here = here, scratch.save(after, "contracted")
        if turn > 1:
            scratch.drop(before_)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([b for b in batches if len(b)] or [pd.DataFrame(columns=["id", "next", "prev", *sums])])
        at = {x: i for i, x in enumerate(rows["id"])}
        following = [at.get(x, -1) if x == x and x is not None else -1 for x in rows["next"]]
        i, order = next((i for i, x in enumerate(rows["prev"]) if x is None or x != x), -1), []
        while i >= 0:
            order.append(i)
            i = following[i]
        if len(order) != len(rows):
            raise ValueError("not one list")
        done = rows.iloc[order]
        yield pd.DataFrame({"id": done["id"], **{c: np.cumsum(done[c].to_numpy(dtype=np.int64)) for c in sums}})

    # ids as text: a null among whole numbers would make them floating-point numbers
    few = here.select(F.col("id").cast("string").alias("id"), F.col("prev").cast("string").alias("prev"), F.col("next").cast("string").alias("next"), *sums)
    known = few.coalesce(1).mapInPandas(walk, f"id string, {kinds}").select(F.col("id").cast("long").alias("id"), *sums)
    known = scratch.save(known, "ranked")
    for out in reversed(gone):
        ahead = known.select(F.col("id").alias("prev"), *(F.col(c).alias(f"{c}_ahead") for c in sums))
        more = out.join(ahead, "prev").select("id", *((F.col(c) + F.col(f"{c}_ahead")).alias(c) for c in sums))
        before_, known = known, scratch.save(known.unionByName(more), "ranked")
        scratch.drop(before_, out)
    return known


def tour(nodes: DataFrame, scratch: Scratch, params: Trie) -> tuple[DataFrame, DataFrame]:
    """(nodes with parent_conv_id, n_children; arcs: id, prev, next, leaves, saved) of a tree whose nodes have a ``no``.

    The arcs of a node are 2 no (enter) and 2 no + 1 (exit). After an enter arc comes that of the first child, or the
    exit; after an exit arc the next sibling's enter arc, or the parent's exit. Siblings are linked inside buckets of a
    hash, then bucket by bucket.
    """
    up = nodes.select(F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("no").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    buckets = 1 + nodes.count() // params.bucket
    tree = scratch.save(nodes.join(up, ["p1", "p2"], "left").withColumn("bucket", F.pmod(seeded(5, "no"), F.lit(buckets))), "tree")
    low = tree.where("parent is not null")
    inside = Window.partitionBy("parent", "bucket").orderBy("no")
    near = low.select("no", "parent", "bucket", F.lag("no").over(inside).alias("left"), F.lead("no").over(inside).alias("right"))
    per = low.groupBy("parent", "bucket").agg(F.min("no").alias("first"), F.max("no").alias("final"), F.count("*").alias("n"))
    across = Window.partitionBy("parent").orderBy("bucket")
    per = per.withColumns({"from": F.lag("final").over(across), "to": F.lead("first").over(across)})
    near = near.join(per.select("parent", "bucket", "from", "to"), ["parent", "bucket"]).select("no", F.coalesce("left", "from").alias("left"), F.coalesce("right", "to").alias("right"))
    kids = per.groupBy("parent").agg(F.min_by("first", "bucket").alias("first"), F.max_by("final", "bucket").alias("final"), F.sum("n").alias("n_children"))
    whole = tree.join(near, "no", "left").join(kids.withColumnRenamed("parent", "no"), "no", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    whole = scratch.save(whole, "siblings")
    enter, exit_ = (lambda c: F.col(c) * 2), (lambda c: F.col(c) * 2 + 1)
    arcs = F.array(
        F.struct(enter("no").alias("id"), F.coalesce(exit_("left"), enter("parent")).alias("prev"), F.coalesce(enter("first"), exit_("no")).alias("next"), (F.col("n_children") == 0).cast("long").alias("leaves"), "saved"),
        F.struct(exit_("no").alias("id"), F.coalesce(exit_("final"), enter("no")).alias("prev"), F.coalesce(enter("right"), exit_("parent")).alias("next"), F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved")),
    )
    return whole, scratch.save(whole.select(F.inline(arcs)), "arcs")


def digests_of_ends(ends: DataFrame, scratch: Scratch) -> DataFrame:
    """n1, n2, ends_sha256: the hash of the comma-joined conv_ids of each node, in numerical order.

    Ranges in order become pieces of up to 4096 ids; a node's pieces then stream through one hash in order, so memory is
    a batch however many conversations end at a node.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, ids = (batch.column(c).to_numpy() for c in ("n1", "n2", "conv_id"))
            cuts = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
            edges = np.unique(np.concatenate([[0], cuts, np.arange(0, len(a), 4096), [len(a)]]))
            text = [",".join(map(str, ids[i:j].tolist())) for i, j in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(a[edges[:-1]]), pa.array(b[edges[:-1]]), pa.array(ids[edges[:-1]]), pa.array(text, pa.string())], names=["n1", "n2", "conv_id", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            out = []
            for a, b, text in zip(*(batch.column(c).to_pylist() for c in ("n1", "n2", "ids")), strict=True):
                if (a, b) != key:
                    if key:
                        out.append((*key, digest.hexdigest()))
                    key, digest = (a, b), hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(("n1", "n2", "ends_sha256"), x, strict=True)) for x in out], schema=schema)
        if key:
            yield pa.RecordBatch.from_pylist([dict(zip(("n1", "n2", "ends_sha256"), (*key, digest.hexdigest()), strict=True))], schema=schema)

    schema = pa.schema([("n1", pa.int64()), ("n2", pa.int64()), ("ends_sha256", pa.string())])
    packed = ends.orderBy("n1", "n2", "conv_id").mapInArrow(pieces, "n1 long, n2 long, conv_id long, ids string")
    ordered = packed.repartition("n1", "n2").sortWithinPartitions("n1", "n2", "conv_id").select("n1", "n2", "ids")
    with batch_bytes(ends.sparkSession, 8 << 20):
        return scratch.save(ordered.mapInArrow(hashed, "n1 long, n2 long, ends_sha256 string"), "ends")


def prefix_trie(turns: DataFrame, params: Trie = Trie()) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns``: conv_id, turn, role, text. Null turns come first, null roles and texts are empty; turns that share a
    number are ordered by role and text, and repeated rows are turns like others. Rows without a conv_id belong to no
    conversation; an empty table has no node, not even a root. Extra columns are ignored.
    """
    scratch = Scratch(turns.sparkSession)
    conversations, rows = rebuilt(turns_in_order(turns.select("conv_id", "turn", "role", "text"), scratch), scratch, params)
    each = scratch.save(with_digests(rows), "digests")
    none = F.lit(None).cast("long")
    nodes = each.groupBy("n1", "n2").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), (F.min("pos") + 1).alias("depth"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("bytes").alias("bytes")
    )
    zero = F.lit(0).cast("long")
    root = conversations.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("n1"), zero.alias("n2"), "conv_id", "n_convs", zero.alias("depth"), none.alias("p1"), none.alias("p2"), zero.alias("bytes"))
    nodes = nodes.unionByName(root).select("*", F.monotonically_increasing_id().alias("no"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    nodes, arcs = tour(scratch.save(nodes, "nodes"), scratch, params)
    sums = ranked(arcs, ("leaves", "saved"), scratch, params.base)
    at = lambda c, arc: F.max(F.when(F.col("id") % 2 == arc, F.col(c)))
    inside = sums.groupBy(F.shiftright("id", 1).alias("no")).agg((at("leaves", 1) - at("leaves", 0)).alias("leaves_below"), (at("saved", 1) - at("saved", 0)).alias("saved_below"))
    turnless = conversations.where("length = 0").select(zero.alias("n1"), zero.alias("n2"), "conv_id")
    ends = digests_of_ends(each.where("last").select("n1", "n2", "conv_id").unionByName(turnless), scratch)
    whole = nodes.join(inside, "no").join(ends, ["n1", "n2"], "left")
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("leaves_below") + (F.col("n_children") == 0).cast("long")).alias("n_leaves"),
        (F.col("saved_below") + F.col("saved")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
