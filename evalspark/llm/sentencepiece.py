"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

White space becomes a marker in front of words. No piece holds the marker behind another character, so a text falls
into chunks (markers and the word behind them) that Viterbi solves independently. Each record batch solves its
distinct chunks once, all of them in step: position by position the trie is walked for every chunk at once.
Characters that no piece covers become byte pieces. A marker character that the text itself holds is written in bytes
too, so decoding returns every text exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from evalspark.llm.common import list_array, offsets_of, slices

MARKER = "▁"
CHUNK = re.compile(rb" +[^ ]*")
#: Score of a character without a piece, below the lowest piece score.
UNKNOWN_PENALTY = 10.0
LONG = 128


@dataclass
class Trie:
    """Double array over bytes: the child of node s by byte c is base[s] + c if check there is s; value is a piece id or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @staticmethod
    def build(keys: dict[bytes, int]) -> Trie:
        root: dict = {}
        for key, piece in keys.items():
            node = root
            for c in key:
                node = node.setdefault(c, {})
            node[-1] = piece
        base, check, value = (np.full(1 << 20, x, np.int32) for x in (0, -1, -1))
        free = np.ones(1 << 20, bool)
        free[:257], queue, start, head, window = False, [(0, root)], 257, 0, 4096
        while head < len(queue):
            at, node = queue[head]
            head += 1
            value[at] = node.get(-1, -1)
            labels = sorted(c for c in node if c >= 0)
            if not labels:
                continue
            start += int(np.argmax(free[start:]))
            place = start
            while True:  # the first place where all labels fit
                if place + window + 512 > len(free):
                    base, check, value = (np.concatenate([x, np.full(len(x), y, np.int32)]) for x, y in ((base, 0), (check, -1), (value, -1)))
                    free = np.concatenate([free, np.ones(len(free), bool)])
                fits = free[place : place + window].copy()
                for c in labels[1:]:
                    fits &= free[place + c - labels[0] : place + c - labels[0] + window]
                if fits.any():
                    break
                place += window
            b = place + int(np.argmax(fits)) - labels[0]
            base[at] = b
            for c in labels:
                free[b + c], check[b + c] = False, at
                queue.append((b + c, node[c]))
        top = int(np.flatnonzero(~free).max()) + 512
        return Trie(base[:top], check[:top], value[:top])


def ranked(scores: np.ndarray) -> bool:
    """Whether the scores are negated ranks of merges: whole numbers, as log probabilities never are throughout."""
    return len(scores) > 1 and bool((scores <= 0).all() and (scores == np.rint(scores)).all())


def zipf(rank: np.ndarray, shift: float = 2.7) -> np.ndarray:
    """Log probabilities that fall with the rank as word frequencies do (Zipf's law with Mandelbrot's shift).

    Merges are made in the order of frequency, so a rank tells about how frequent a piece is; nothing is trained.
    """
    p = 1 / (rank + shift)
    return np.log(p / p.sum())


@dataclass
class Vocabulary:
    pieces: list[bytes]
    scores: np.ndarray
    bytes_at: np.ndarray
    unknown: float
    trie: Trie = field(repr=False)

    @staticmethod
    def of(pieces: list[tuple[str, float]], byte_ids: list[int]) -> Vocabulary:
        """pieces: (piece, log score) by id, a score of None for control pieces; byte_ids: the ids of bytes 0 to 255."""
        special = set(byte_ids)
        keys = {p.replace(MARKER, " ").encode(): i for i, (p, s) in enumerate(pieces) if s is not None and p and i not in special}
        for key in keys:
            if b" " in key.lstrip(b" "):
                raise ValueError(f"a piece holds white space behind another character: {key!r}")
        raw = [p.replace(MARKER, " ").encode() if s is not None else b"" for p, s in pieces]
        for value, i in enumerate(byte_ids):
            raw[i] = bytes([value])
        scores = np.array([0.0 if s is None else s for _, s in pieces])
        return Vocabulary(raw, scores, np.array(byte_ids, np.int32), float(min(scores[list(keys.values())])) - UNKNOWN_PENALTY, Trie.build(keys))

    @staticmethod
    def load(path: str) -> Vocabulary:
        """Reads pieces and scores of a model file; the library is used for reading only.

        A file of merges has ranks as scores, not probabilities. Its pieces get log probabilities by their ranks.
        """
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.vocab_size()
        use = [not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i) or m.is_byte(i)) for i in range(n)]
        scores = np.array([m.get_score(i) for i in range(n)])
        if ranked(scores[use]):
            scores[use] = zipf(np.argsort(np.argsort(-scores[use], kind="stable")))
        byte = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        return Vocabulary.of([(m.id_to_piece(i), float(scores[i]) if use[i] or i in set(byte) else None) for i in range(n)], byte)

    # -- encoding

    def solve(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all chunks in one array, and offsets."""
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        order = np.argsort(size, kind="stable")
        order, far = order[size[order] <= LONG], order[size[order] > LONG]
        cells, at = 1 << 20, 0
        counts = np.zeros(len(chunks), np.int64)
        found = []
        while at < len(order):
            step = max(1, cells // max(8, int(size[order[at]]) * 2))
            to = min(len(order), at + step)
            ids, lens = self._lockstep([chunks[i] for i in order[at:to]], size[order[at:to]])
            counts[order[at:to]] = lens
            found.append(ids)
            at = to
        for i in far:
            ids = self._single(chunks[i])
            counts[i] = len(ids)
            found.append(ids)
        done = np.concatenate([order, far])
        flat = np.concatenate(found) if found else np.zeros(0, np.int32)
        begin = np.zeros(len(chunks), np.int64)
        begin[done] = offsets_of(counts[done])[:-1]
        offsets = offsets_of(counts)
        return flat[np.repeat(begin - offsets[:-1], counts) + np.arange(offsets[-1])], offsets

    def _lockstep(self, words: list[bytes], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        w, longest = len(words), int(size.max())
        text = np.zeros((w, longest + 1), np.int64)
        text[np.arange(longest + 1) < size[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        wide = np.where(text < 0x80, 1, np.where(text < 0xE0, 2, np.where(text < 0xF0, 3, 4)))
        best = np.full((w, longest + 1), -np.inf)
        best[:, 0] = 0
        came, piece = np.zeros((w, longest + 1), np.int32), np.zeros((w, longest + 1), np.int32)
        for i in range(longest):
            rows = np.flatnonzero((best[:, i] > -np.inf) & (size > i))
            if not len(rows):
                continue
            covered, char, score = np.zeros(w, bool), wide[rows, i], best[rows, i]
            live, node, n = np.arange(len(rows)), np.zeros(len(rows), np.int32), 0
            while len(live):
                go = base[node] + text[rows[live], i + n]
                ok = (check[go] == node) & (size[rows[live]] > i + n)
                live, node = live[ok], go[ok].astype(np.int32)
                if not len(live):
                    break
                n += 1
                v = value[node]
                hit = np.flatnonzero(v >= 0)
                r = rows[live[hit]]
                covered[r[char[live[hit]] == n]] = True
                sum_ = score[live[hit]] + self.scores[v[hit]]
                better = sum_ > best[r, i + n]
                r = r[better]
                best[r, i + n], came[r, i + n], piece[r, i + n] = sum_[better], i, v[hit][better]
            bare = np.flatnonzero(~covered[rows])
            for k in range(1, 5):
                r = rows[bare[char[bare] == k]]
                if len(r):
                    sum_ = best[r, i] + self.unknown
                    r = r[sum_ > best[r, i + k]]
                    best[r, i + k] = best[r, i] + self.unknown
                    for q in range(1, k + 1):
                        came[r, i + q], piece[r, i + q] = i + q - 1, self.bytes_at[text[r, i + q - 1]]
        ids, lens, pos, live = np.zeros((w, longest), np.int32), np.zeros(w, np.int64), size.copy(), np.flatnonzero(size > 0)
        while len(live):
            p = pos[live]
            ids[live, lens[live]] = piece[live, p]
            lens[live] += 1
            pos[live] = came[live, p]
            live = live[pos[live] > 0]
        back = np.repeat(np.cumsum(lens), lens) - np.arange(lens.sum()) - 1
        return ids[np.repeat(np.arange(w), lens), back], lens

    def cut(self, chunk: bytes) -> list[bytes]:
        """A long chunk cut at all places that no piece crosses: its best pieces are those of its parts in turn.

        The trie is walked from every character at once, so a text without spaces costs a few array steps.
        """
        text = np.frombuffer(chunk, np.uint8).astype(np.int64)
        heads = (text & 0xC0) != 0x80
        live = np.flatnonzero(heads)
        node, k, crossed = np.zeros(len(live), np.int32), 0, np.zeros(len(text) + 1, np.int64)
        while len(live):
            ok = live + k < len(text)
            live, node = live[ok], node[ok]
            go = self.trie.base[node] + text[live + k]
            ok = self.trie.check[go] == node
            live, node, k = live[ok], go[ok].astype(np.int32), k + 1
            whole = live[self.trie.value[node] >= 0]
            crossed[whole + 1] += 1
            crossed[whole + k] -= 1
        free = np.flatnonzero((np.cumsum(crossed[:-1]) == 0) & heads)
        edges = [0, *free[free > 0].tolist(), len(chunk)]
        return [chunk[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]

    @cached_property
    def _lists(self) -> tuple[list, ...]:
        return tuple(x.tolist() for x in (self.trie.base, self.trie.check, self.trie.value, self.scores))

    def _single(self, word: bytes) -> np.ndarray:
        """The same for one long chunk."""
        base, check, value, scores = self._lists
        n = len(word)
        best, came, piece = [-np.inf] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            if best[i] == -np.inf:
                continue
            char = 1 if word[i] < 0x80 else 2 if word[i] < 0xE0 else 3 if word[i] < 0xF0 else 4
            node, covered, at = 0, False, i
            while at < n:
                go = base[node] + word[at]
                if check[go] != node:
                    break
                node, at = go, at + 1
                if (v := value[node]) >= 0:
                    covered |= at - i == char
                    if (s := best[i] + scores[v]) > best[at]:
                        best[at], came[at], piece[at] = s, i, v
            if not covered and best[i] + self.unknown > best[i + char]:
                best[i + char] = best[i] + self.unknown
                for q in range(1, char + 1):
                    came[i + q], piece[i + q] = i + q - 1, int(self.bytes_at[word[i + q - 1]])
        ids, pos = [], n
        while pos:
            ids.append(piece[pos])
            pos = came[pos]
        return np.array(ids[::-1], np.int32)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts in one array, and offsets."""
        parts = [CHUNK.findall(b" " + t) if t else [] for t in texts]
        for i, p in enumerate(parts):
            if max(map(len, p), default=0) > LONG:
                parts[i] = [x for c in p for x in (self.cut(c) if len(c) > LONG else (c,))]
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        coded = pa.array([c for p in parts for c in p], pa.binary()).dictionary_encode()
        ids, at = self.solve(coded.dictionary.to_pylist())
        use = coded.indices.to_numpy()
        count = np.diff(at)[use]
        offsets = offsets_of(count)
        flat = ids[np.repeat(at[:-1][use] - offsets[:-1], count) + np.arange(offsets[-1])]
        return flat, offsets[offsets_of(n)]

    def decode(self, ids: list[int]) -> bytes:
        """The text of piece ids: markers become spaces, the one in front of the text goes, byte pieces join."""
        out = b"".join(map(self.pieces.__getitem__, ids))
        return out[1:] if out[:1] == b" " else out


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _LOADED:
        _LOADED[path] = Vocabulary.load(path)
    return _LOADED[path]


def encoded(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids, n_tokens, text as decoded from the ids, exact (that it equals the input text).

    A null text has null ids, null text and 0 tokens and is exact; an empty text has no ids. ``model_path`` is a file
    that every executor has. One row in, one row out, so null and repeated ids stay as they are; other columns are
    ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_path)
        for batch in slices(batches):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            ids, at = v.encode([t or b"" for t in texts])
            flat = ids.tolist()
            back = [None if t is None else v.decode(flat[a:b]) for t, a, b in zip(texts, at[:-1].tolist(), at[1:].tolist(), strict=True)]
            null = pa.array([t is None for t in texts])
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32), pa.int32()), pa.array(ids, pa.int32()), mask=null) if null.true_count else list_array(ids, at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), lists, pa.array(np.diff(at)), pa.array([b if b is None else b.decode() for b in back], pa.string()), pa.array([a == b for a, b in zip(texts, back, strict=True)])],
                names=["doc_id", "ids", "n_tokens", "text", "exact"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, text string, exact boolean")
