"""Toxicity: a learned lexicon, met with misspellings by Levenshtein automata, and context windows.

Terms are whole words or word stems whose documents are marked toxic far more often than others. The lexicon is a trie;
the automaton that accepts every term with at most one edit is intersected with it, state by state as a word asks for it.
Each hit is weighed by its term and looks at its
context window: hits between quotation marks are counted apart from open ones, hits close together strengthen each
other. A small logistic model turns these sums into a score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import Scratch, code_points, labelled_sample, logistic, slices, texts_of

#: Quotation marks, opening and closing.
QUOTES = "\"“”„«»‹›‘’"


@dataclass(frozen=True)
class Toxicity:
    #: Labelled documents that lexicon and model learn from (a share by hash, about this many), and code points at
    #: which it stops.
    rows: int = 20_000
    code_points: int = 1 << 28
    #: Toxic texts and share of toxic texts that a term needs (equal texts count once).
    support: int = 4
    purity: float = 0.8
    stems: tuple[int, ...] = (4, 5, 6, 7)
    #: Letters that a term needs to be met with an edit.
    fuzzy_word: int = 5
    fuzzy_stem: int = 6
    #: Words to either side of a hit.
    context: int = 8
    threshold: float = 0.7


def word_table() -> np.ndarray:
    """Lower-case letter or digit of each code point, 0 for others."""
    from evalspark.llm import common

    if "word" not in common._TABLES:
        table = common.letter_table().copy()
        table[table == 32] = 0
        digits = [c for c in range(0x110000) if chr(c).isnumeric()]
        table[digits] = digits
        common._TABLES["word"] = table
    return common._TABLES["word"]


@dataclass
class Tokens:
    chars: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    row: np.ndarray
    quoted: np.ndarray


def tokens(batch: pa.RecordBatch) -> Tokens:
    """Runs of letters and digits of all rows, and whether each stands behind an odd number of quotation marks of its line."""
    cp, at = code_points(texts_of(batch))
    x = word_table()[cp]
    row_of = np.repeat(np.arange(batch.num_rows), np.diff(at))
    inside = x > 0
    prev = np.concatenate([[False], inside[:-1] & (row_of[1:] == row_of[:-1])]) if len(x) else inside
    begin = np.flatnonzero(inside & ~prev)
    after = np.concatenate([inside[1:] & (row_of[1:] == row_of[:-1]), [False]]) if len(x) else inside
    end = np.flatnonzero(inside & ~after) + 1
    marks = np.isin(cp, [ord(c) for c in QUOTES[:8]])
    count = np.cumsum(marks)
    fresh = (cp == 10) | np.concatenate([[True], row_of[1:] != row_of[:-1]]) if len(x) else inside
    line = np.maximum.accumulate(np.where(fresh, np.arange(len(cp)), 0)) if len(x) else begin
    before = count - marks
    quoted = (count[begin] - before[line[begin]]) % 2 == 1 if len(begin) else np.zeros(0, bool)
    return Tokens(x, begin, end - begin, row_of[begin], quoted)


def candidate_terms(rows: DataFrame, p: Toxicity) -> list[tuple[str, float]]:
    """(term, weight) of every term with the support and purity asked for; a stem ends in ``*``.

    Spark counts distinct texts (one whose copies disagree goes with most of them) and takes out the terms that others
    stand for; the lexicon reaches the driver whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            t = tokens(batch)
            words = [set() for _ in range(batch.num_rows)]
            text = "".join(map(chr, t.chars.tolist()))
            for b, n, r in zip(t.begin.tolist(), t.size.tolist(), t.row.tolist(), strict=True):
                if n > 2:
                    words[r].add(text[b : b + n])
            out, toxic = [], []
            for seen, label in zip(words, batch.column("toxic").to_pylist(), strict=True):
                keys = seen | {w[:k] + "*" for w in seen for k in p.stems if len(w) >= k}
                out += keys
                toxic += [label] * len(keys)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(toxic, pa.int64())], names=["term", "toxic"])

    texts = rows.groupBy("text").agg((F.avg("toxic") >= 0.5).cast("long").alias("toxic"))
    total = texts.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    if not total["t"] or total["t"] == total["n"]:
        return []
    seen = texts.mapInArrow(run, "term string, toxic long").groupBy("term").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    rate = total["t"] / total["n"]
    good = seen.where((F.col("t") >= p.support) & (F.col("t") >= p.purity * F.col("n")) & (F.col("t") > 2 * rate * F.col("n")))
    best = uncovered(Scratch(rows.sparkSession).save(good, "terms"), p).collect()
    best.sort(key=lambda r: (-r["t"], r["n"], -len(r["term"]), r["term"]))
    return [(r["term"], math.log((r["t"] + 0.5) / (r["n"] - r["t"] + 0.5)) - math.log(rate / (1 - rate))) for r in best]


def uncovered(good: DataFrame, p: Toxicity) -> DataFrame:
    """The terms (term, t, n) without those that others stand for.

    A stem whose texts are all those of a longer term gives way to it. Then a stem covers the terms that it begins, but
    one that is too short to be met with an edit leaves those that may be; a whole word covers no other.
    """
    stem = F.rtrim(F.lit("*"), F.col("term"))
    whole, size = F.col("term") == stem, F.length(stem)
    fuzzy = size >= F.when(whole, p.fuzzy_word).otherwise(p.fuzzy_stem)
    heads = [F.when((size > k) | (whole & (size == k)), F.concat(F.substring(stem, 1, k), F.lit("*"))) for k in p.stems]

    def begun(terms: DataFrame) -> DataFrame:
        return terms.select("term", "t", "n", fuzzy.alias("fuzzy"), F.explode(F.array_compact(F.array(*heads))).alias("head"))

    wider = begun(good).select(F.col("head").alias("term"), "t", "n").distinct()
    kept = good.join(wider, ["term", "t", "n"], "left_anti")
    stems = kept.where(~whole).select(F.col("term").alias("head"), (size >= p.fuzzy_stem).alias("reaches"))
    covered = begun(kept).join(stems, "head").where(F.col("reaches") | ~F.col("fuzzy")).select("term").distinct()
    return kept.join(covered, "term", "left_anti")


#: Words that a worker remembers with what they met; beyond, it begins anew.
REMEMBERED = 400_000


@dataclass
class Automaton:
    """The lexicon's trie, intersected with the automaton of at most one edit as words ask for it.

    A state of the intersection is a trie node and the edits spent. Without an edit there is one path. Where a path
    spends its edit, the children from which the next letter leads on are looked up, not tried: ``onward[node, letter]``.
    So nothing is made deterministic ahead, and memory is linear in the letters of all terms, whatever the alphabet.

    ``hit[state]`` of the state that ``walk`` gives is the number of the term met (-1 none), ``edits[state]`` how.
    """

    #: Children by (node, letter); children by node and the letter behind them; and the smallest number of a stem and of
    #: a whole word that ends at a node, and at a child of a node.
    child: dict[tuple[int, str], int]
    onward: dict[tuple[int, str], tuple[int, ...]]
    stems: dict[int, int]
    wholes: dict[int, int]
    stems_below: dict[int, int]
    wholes_below: dict[int, int]
    exact_stems: dict[str, int]
    exact_wholes: dict[str, int]
    stem_sizes: list[int]
    hit: np.ndarray
    edits: np.ndarray
    weights: np.ndarray
    terms: list[str] = field(default_factory=list)
    known: dict[str, int] = field(default_factory=dict)

    @staticmethod
    def build(terms: list[tuple[str, float]], p: Toxicity) -> Automaton:
        child, parent, stems, wholes, exact_stems, exact_wholes = {}, [-1], {}, {}, {}, {}
        for i, (term, _) in enumerate(terms):
            stem = term.rstrip("*")
            (exact_stems if term != stem else exact_wholes).setdefault(stem, i)
            if len(stem) < (p.fuzzy_stem if term != stem else p.fuzzy_word):
                continue
            at = 0
            for c in stem:
                if (at, c) not in child:
                    child[at, c] = len(parent)
                    parent.append(at)
                at = child[at, c]
            (stems if term != stem else wholes).setdefault(at, i)
        onward: dict = {}
        for (node, c), _ in child.items():
            if node:
                onward.setdefault((parent[node], c), []).append(node)
        below: list[dict[int, int]] = [{}, {}]
        for found, of in zip((stems, wholes), below, strict=True):
            for node, i in found.items():
                of[parent[node]] = min(i, of.get(parent[node], i))
        numbers = np.arange(len(terms), dtype=np.int32)
        return Automaton(
            child, {k: tuple(x) for k, x in onward.items()}, stems, wholes, *below, exact_stems, exact_wholes, sorted({len(x) for x in exact_stems}),
            np.concatenate([[-1], np.repeat(numbers, 2)]).astype(np.int32), np.concatenate([[0], np.tile([0, 1], len(terms))]).astype(np.int8),
            np.array([w for _, w in terms]), [t for t, _ in terms],
        )

    def near(self, w: str) -> int:
        """The smallest number of a term that is one edit away from the word (a stem: from a beginning of it); -1 if none."""
        best, n, child, node = len(self.terms), len(w), self.child, 0
        for i in range(n + 1):
            # the edit is here: a letter too many, another letter, a missing letter; then all is as in the term
            ways = [(node, i + 1)] if i < n else []
            for j in (i + 1, i) if i < n else (i,):
                best = min(best, self.stems_below.get(node, best))
                if j == n:
                    best = min(best, self.wholes_below.get(node, best))
                else:
                    ways += [(x, j) for x in self.onward.get((node, w[j]), ())]
            for at, j in ways:
                while at is not None:
                    best = min(best, self.stems.get(at, best))
                    if j == n:
                        best = min(best, self.wholes.get(at, best))
                        break
                    at, j = child.get((at, w[j])), j + 1
            node = child.get((node, w[i])) if i < n else None
            if node is None:
                break
        return best if best < len(self.terms) else -1

    def met(self, w: str) -> int:
        """State of a word: its shortest exact stem, else itself, else the first term that is one edit away."""
        for k in self.stem_sizes:
            if k > len(w):
                break
            if w[:k] in self.exact_stems:
                return 1 + 2 * self.exact_stems[w[:k]]
        if w in self.exact_wholes:
            return 1 + 2 * self.exact_wholes[w]
        i = self.near(w)
        return 2 + 2 * i if i >= 0 else 0

    def walk(self, t: Tokens) -> np.ndarray:
        """The state in which each token ends."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, text = self.known, t.chars.astype("<u4").tobytes().decode("utf-32-le")
        out = np.zeros(len(t.begin), np.int32)
        for k, (b, n) in enumerate(zip(t.begin.tolist(), t.size.tolist(), strict=True)):
            w = text[b : b + n]
            state = known.get(w)
            if state is None:
                state = self.met(w)
                if n <= 64:
                    known[w] = state
            out[k] = state
        return out


def features(batch: pa.RecordBatch, a: Automaton, p: Toxicity) -> np.ndarray:
    """Per row: weights of open exact, open misspelled, quoted exact and quoted misspelled hits, best window, density."""
    t = tokens(batch)
    state = a.walk(t)
    hits = np.flatnonzero(a.hit[state] >= 0)
    rows, n = batch.num_rows, np.bincount(t.row, minlength=batch.num_rows)
    out = np.zeros((rows, 6))
    if len(hits):
        weight, fuzzy, quoted, row = a.weights[a.hit[state[hits]]], a.edits[state[hits]] > 0, t.quoted[hits], t.row[hits]
        for k, mask in enumerate((~fuzzy & ~quoted, fuzzy & ~quoted, ~fuzzy & quoted, fuzzy & quoted)):
            np.add.at(out[:, k], row[mask], weight[mask])
        # hits of one row within the context window of each hit
        place = row * np.int64(1 << 40) + hits
        sums = np.concatenate([[0.0], np.cumsum(weight * np.where(fuzzy, 0.5, 1.0) * np.where(quoted, 0.25, 1.0))])
        near = sums[np.searchsorted(place, place + p.context, "right")] - sums[np.searchsorted(place, place - p.context, "left")]
        np.maximum.at(out[:, 4], row, near)
    out[:, 5] = out[:, :4].sum(1) / np.maximum(n, 20) * 20
    return np.log1p(np.maximum(out, 0))


@dataclass
class Model:
    automaton: Automaton | None
    weights: np.ndarray

    def score(self, batch: pa.RecordBatch, p: Toxicity) -> np.ndarray:
        z = np.full(batch.num_rows, self.weights[0])
        if self.automaton is not None:
            z = z + features(batch, self.automaton, p) @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, params: Toxicity = Toxicity()) -> Model:
    """Learns from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic 0 or 1). Without toxic rows, or without others,
    every text scores alike."""
    p = params
    rows, _ = labelled_sample(docs, labels, "toxic", p.rows, chars=p.code_points)
    terms = candidate_terms(rows, p)
    if not terms:
        mean = rows.agg(F.avg("toxic")).first()[0] or 0.0
        mean = min(max(mean, 1e-3), 1 - 1e-3)
        return Model(None, np.array([math.log(mean / (1 - mean)), *[0.0] * 6]))
    automaton = Automaton.build(terms, p)
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = features(batch, shared.value, p)
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in x.T), batch.column("toxic")], names=[*"abcdef", "y"])

    got = rows.select("text", "toxic").mapInArrow(run, ", ".join(f"{c} double" for c in "abcdef") + ", y long").toPandas().to_numpy(float)
    got = got[np.lexsort(got.T)]
    return Model(automaton, logistic(got[:, :6], got[:, 6], l2=1e-4))


def scored(docs: DataFrame, model: Model, params: Toxicity = Toxicity()) -> DataFrame:
    """doc_id, score (0 to 1), predicted (score >= threshold). Null and empty texts score as texts without a hit. One row
    in, one row out, so null and repeated ids stay as they are; extra columns are ignored."""
    p, shared = params, docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            s = shared.value.score(batch, p)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= p.threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")
