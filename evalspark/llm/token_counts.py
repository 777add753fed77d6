"""Edit-aware token counts: a segment tree of pre-tokens per document, re-encoded only around edits.

A byte-level BPE never merges across pre-tokens, so the count of a text is the sum over its pre-tokens. Each document
keeps them in blocks under a binary tree of (characters, tokens) sums, a row of a stored table; edits read that row and
give the next one. An edit finds its place by walking down the character sums, matches pre-tokens anew from the one that touches the edit until a match begins where an old one
behind the edit begins (from there on the old ones hold), and corrects the sums from the touched blocks to the root.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from evalspark.llm.common import list_array, offsets_of, slices

BLOCK = 64
#: Pre-tokens whose counts a worker remembers.
REMEMBERED = 400_000


class Known(dict):
    """Token counts of pre-tokens met before; a missing one is encoded."""

    def __init__(self, encode: Callable[[str], list[int]]):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self[piece] = len(self.encode(piece))
        return n


@dataclass
class Counter:
    """Token counts of pre-tokens, by a rank file of byte pairs and the pattern that splits texts."""

    path: str
    pattern: str

    def __post_init__(self):
        import base64

        import regex
        import tiktoken

        with open(self.path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.split = regex.compile(self.pattern)

        self.known = Known(self.encode)


def numbers(values: Iterable[int], n: int) -> np.ndarray:
    return np.fromiter(values, np.int32, n)


def shape(lens: np.ndarray, counts: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray, list[int], list[int]]:
    """sizes of the blocks, lens, counts, and the sums of characters and tokens by node of the tree."""
    starts = np.arange(0, len(lens), BLOCK)
    width = 1 << max(len(starts) - 1, 0).bit_length()
    sums = []
    for x in (lens, counts):
        node = [0] * width + (np.add.reduceat(x, starts).tolist() if len(x) else [])
        node += [0] * (2 * width - len(node))
        for i in range(width - 1, 0, -1):
            node[i] = node[2 * i] + node[2 * i + 1]
        sums.append(node)
    return np.diff(np.append(starts, len(lens))).tolist() or [0], lens, counts, *sums


class PieceTree:
    """Pre-tokens of one text in blocks (text, lengths and counts of its pieces), and for every node of a binary tree over
    the blocks the characters and tokens below it."""

    def __init__(self, counter: Counter, text: str, sizes: list[int], lens: np.ndarray, counts: np.ndarray, chars: list[int], tokens: list[int]):
        """``sizes``: pieces of each block; ``lens`` and ``counts``: of all pieces; ``chars`` and ``tokens``: of the nodes."""
        self.counter, self.encoded = counter, 0
        self.chars, self.tokens, self.width = chars, tokens, len(chars) // 2
        ends = list(itertools.accumulate(sizes))
        self.lens, self.counts = ([x[e - n : e] for e, n in zip(ends, sizes, strict=True)] for x in (lens, counts))
        leaves = chars[self.width : self.width + len(sizes)]
        self.blocks = [text[e - n : e] for e, n in zip(itertools.accumulate(leaves), leaves, strict=True)]

    @staticmethod
    def of(text: str, counter: Counter) -> PieceTree:
        pieces = counter.split.findall(text)
        return PieceTree.rebuilt(counter, text, numbers(map(len, pieces), len(pieces)), numbers(map(counter.known.__getitem__, pieces), len(pieces)))

    @staticmethod
    def rebuilt(counter: Counter, text: str, lens: np.ndarray, counts: np.ndarray) -> PieceTree:
        """Fresh blocks and sums from counts that are known."""
        return PieceTree(counter, text, *shape(lens, counts))

    def _leaf(self, i: int) -> None:
        self.chars[self.width + i], self.tokens[self.width + i] = len(self.blocks[i]), int(self.counts[i].sum())

    def _sum(self, i: int) -> None:
        self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def count(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join(self.blocks)

    def _find(self, at: int) -> tuple[int, int]:
        """The block that holds character ``at`` (or ends there) and where the block begins."""
        i, begin = 1, 0
        while i < self.width:
            i *= 2
            if self.chars[i] + begin < at:
                begin += self.chars[i]
                i += 1
        return min(i - self.width, len(self.blocks) - 1), begin

    def edit(self, at: int, remove: int, insert: str) -> None:
        """Replaces ``remove`` characters from ``at`` on; places beyond the text are moved to its end."""
        at = min(max(at, 0), self.chars[1])
        end = min(at + max(remove, 0), self.chars[1])
        first, top = self._find(at - 1)
        begin, keep, head = top, 0, self.lens[first].tolist()
        # a run of white space ends by what stands two places behind it, so a piece that ends just before the edit may change
        while keep < len(head) and begin + head[keep] < at - 1:
            begin += head[keep]
            keep += 1
        to, more = self._find(end)[0] + 1, 1
        while (found := self._matched(first, min(to + more, len(self.blocks)), top, begin, at, end, insert)) is None:
            more *= 2
        fresh, block, k = found
        self.encoded += len(fresh)
        last = min(block, len(self.blocks) - 1)
        text, lens, counts = self.blocks[block][int(self.lens[block][:k].sum()) :] if block < len(self.blocks) else "", self.lens[last][k:], self.counts[last][k:]
        if block == len(self.blocks):
            lens, counts = lens[:0], counts[:0]
        self.blocks[first] = self.blocks[first][: begin - top] + "".join(fresh) + text
        self.lens[first] = np.concatenate([self.lens[first][:keep], numbers(map(len, fresh), len(fresh)), lens])
        self.counts[first] = np.concatenate([self.counts[first][:keep], numbers(map(self.counter.known.__getitem__, fresh), len(fresh)), counts])
        for i in range(first + 1, last + 1):
            self.blocks[i], self.lens[i], self.counts[i] = "", self.lens[i][:0], self.counts[i][:0]
        if len(self.lens[first]) > 8 * BLOCK:
            new = PieceTree.rebuilt(self.counter, self.text, np.concatenate(self.lens), np.concatenate(self.counts))
            self.blocks, self.lens, self.counts, self.chars, self.tokens, self.width = new.blocks, new.lens, new.counts, new.chars, new.tokens, new.width
            return
        for i in range(first, last + 1):
            self._leaf(i)
        changed = {(self.width + i) // 2 for i in range(first, last + 1)}
        while changed - {0}:
            for i in changed - {0}:
                self._sum(i)
            changed = {i // 2 for i in changed}

    def _matched(self, first: int, stop: int, top: int, begin: int, at: int, end: int, insert: str) -> tuple[list[str], int, int] | None:
        """New pieces from ``begin`` on, and the block and piece from which on the old ones hold; None where the text of
        the blocks up to ``stop`` does not tell."""
        old = "".join(self.blocks[first:stop])
        text = old[begin - top : at - top] + insert + old[end - top :]
        whole, behind, shift = stop == len(self.blocks), at - begin + len(insert), len(insert) - (end - at)
        starts, place = {}, top
        for block in range(first, stop):
            for k, n in enumerate(self.lens[block].tolist()):
                starts[place] = block, k
                place += n
        fresh: list[str] = []
        for m in self.counter.split.finditer(text):
            if m.start() >= behind and (there := starts.get(begin + m.start() - shift)):
                return fresh, *there
            if not whole and m.end() > len(text) - 2:
                return None
            fresh.append(m[0])
        return (fresh, len(self.blocks), 0) if whole else None


_COUNTERS: dict[tuple[str, str], Counter] = {}


def counter_of(path: str, pattern: str) -> Counter:
    key = path, pattern
    if key not in _COUNTERS:
        _COUNTERS[key] = Counter(path, pattern)
    return _COUNTERS[key]


SCHEMA = (
    "doc_id long, text string, sizes array<int>, lens array<int>, counts array<int>, chars array<long>, tokens array<long>, "
    "n_pieces long, tokens_before long, n_edits long, tokens_after long, n_reencoded long, chars_after long"
)
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def lists(rows: list, kind: pa.DataType) -> pa.Array:
    """A list column of arrays or lists of numbers."""
    flat = np.concatenate([np.asarray(x, np.int64) for x in rows])
    return list_array(flat, offsets_of(np.fromiter(map(len, rows), np.int64, len(rows))), kind)


def stored(ids: pa.Array, texts: pa.Array, trees: list[tuple], counts: list[tuple]) -> pa.RecordBatch:
    """Rows of the table from (sizes, lens, counts, chars, tokens) of each tree and its six counts."""
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
    columns = [lists(c, k) for c, k in zip(zip(*trees, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays([ids, texts, *columns, *(pa.array(x, pa.int64()) for x in zip(*counts, strict=True))], names=NAMES)


def built(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """The tree of every row of ``docs`` (doc_id, text) as a row to be stored, and its counts.

    ``n_pieces`` and ``tokens_before`` are those of the text, and stay; ``n_edits``, ``tokens_after``, ``n_reencoded`` and
    ``chars_after`` follow the edits. A null text is empty. Other columns are ignored. ``rank_file`` is a file that every
    executor has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter_of(rank_file, pattern)
        for batch in slices(batches):
            trees = []
            for text in batch.column("text").to_pylist():
                pieces = c.split.findall(text or "")
                trees.append(shape(numbers(map(len, pieces), len(pieces)), numbers(map(c.known.__getitem__, pieces), len(pieces))))
            counts = [(len(lens), tokens[1], 0, tokens[1], 0, chars[1]) for _, lens, _, chars, tokens in trees]
            yield stored(batch.column("doc_id"), batch.column("text").fill_null(""), trees, counts)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def edited(trees: DataFrame, rank_file: str, pattern: str, *policies: Callable[[str], list[dict]]) -> DataFrame:
    """Stored trees after edits: of the column ``edits`` (array of structs at, remove, insert), or those that each policy
    in turn finds in the text that it is given.

    Edits are in code points and applied in turn, each to the outcome of those before it; null ones are none. Only rows
    with edits are unpacked, and only pre-tokens around edits are encoded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter_of(rank_file, pattern)
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            todo = [[] if e is None else e for e in batch.column("edits").to_pylist()] if not policies else list(map(policies[0], texts))
            some = pa.array([bool(e) or any(policy(t) for policy in policies[1:]) for e, t in zip(todo, texts, strict=True)], pa.bool_())
            yield batch.select(NAMES).filter(pc.invert(some))
            rows = np.flatnonzero(some.to_numpy(zero_copy_only=False))
            if not len(rows):
                continue
            flat = {x: (batch.column(x).values.to_numpy(), batch.column(x).offsets.to_numpy()) for x in ("sizes", "lens", "counts", "chars", "tokens")}
            part = lambda x, i: flat[x][0][flat[x][1][i] : flat[x][1][i + 1]]  # noqa: E731, B023
            old = batch.select(["n_pieces", "tokens_before", "n_edits", "n_reencoded"]).take(pa.array(rows)).to_pylist()
            new, trees, counts = [], [], []
            for i, was in zip(rows.tolist(), old, strict=True):
                tree = PieceTree(c, texts[i], part("sizes", i).tolist(), part("lens", i), part("counts", i), part("chars", i).tolist(), part("tokens", i).tolist())
                n_edits = 0
                for policy in policies or (None,):
                    edits = todo[i] if policy is None else policy(tree.text)
                    n_edits += len(edits)
                    for e in edits:
                        tree.edit(e["at"], e["remove"], e["insert"] or "")
                new.append(tree.text)
                trees.append((list(map(len, tree.lens)), np.concatenate(tree.lens), np.concatenate(tree.counts), tree.chars, tree.tokens))
                counts.append((was["n_pieces"], was["tokens_before"], was["n_edits"] + n_edits, tree.count, was["n_reencoded"] + tree.encoded, tree.chars[1]))
            yield stored(batch.column("doc_id").take(pa.array(rows)), pa.array(new, pa.string()), trees, counts)

    return trees.mapInArrow(run, SCHEMA)


def counted(trees: DataFrame) -> DataFrame:
    """doc_id, n_pieces, tokens_before, n_edits, tokens_after, n_reencoded, chars_after of stored trees."""
    return trees.select("doc_id", "n_pieces", "tokens_before", "n_edits", "tokens_after", "n_reencoded", "chars_after")
