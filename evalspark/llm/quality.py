"""Quality rules: counted rules, and a hashed word and character n-gram logistic regression with calibrated output.

The model is trained on a bounded sample of labelled rows and scores every text in Arrow batches: the mean weight of
the text's hashed features, made a probability by a calibration on scores of rows that their model had not learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import U64, code_points, hash_words, join_hashes, labelled_sample, logistic, mix, offsets_of, slices, texts_of

SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Quality:
    #: Labelled rows that the model learns from (a share by hash, about this many), and code points at which it stops.
    rows: int = 3000
    code_points: int = 1 << 26
    bits: int = 16
    #: Letters of the character n-grams.
    chars: int = 3
    steps: int = 150
    #: Calibrated probability of good quality that keeps a text.
    threshold: float = 0.5
    min_words: int = 10
    repeat_words: int = 5
    max_repeat_percent: int = 20


def base_counts(batch: pa.RecordBatch, p: Quality) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each row, and the words' hashes."""
    texts = texts_of(batch)
    parts = [t.split() for t in texts]
    n = np.fromiter(map(len, parts), np.int64, len(parts))
    at = offsets_of(np.fromiter(map(len, texts), np.int64, len(texts)))
    raw = np.frombuffer(b"".join(texts), np.uint8)

    def per_row(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([np.zeros(1, np.int64), np.cumsum(mask)])[at])

    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    out = {"n_words": n, "word_chars": per_row(((raw & 0xC0) != 0x80) & ~space), "n_symbols": per_row(np.isin(raw, np.frombuffer(SYMBOLS, np.uint8)))}
    lines = []
    for t in texts:
        used = [x for x in t.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
        lines.append(len(used) - len(set(used)))
    out["n_dup_lines"] = np.array(lines, np.int64)
    h, row, k = hash_words([w for q in parts for w in q]), np.repeat(np.arange(len(parts)), n), p.repeat_words
    out["n_repeat_words"] = np.zeros(len(parts), np.int64)
    if len(h) >= k:
        g = h[: len(h) - k + 1]
        for j in range(1, k):
            g = join_hashes(g, h[j : len(h) - k + 1 + j])
        inside = np.flatnonzero(row[: len(g)] == row[k - 1 :])
        key = mix(g[inside] ^ mix(row[inside].astype(U64)))  # a window of one text only meets those of the same text
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        edge = np.zeros(len(h) + 1, np.int64)
        twice = inside[count[back] > 1]
        np.add.at(edge, twice, 1)
        np.add.at(edge, twice + k, -1)
        out["n_repeat_words"] = np.bincount(row[np.cumsum(edge[:-1]) > 0], minlength=len(parts)).astype(np.int64)
    out["hashes"] = h
    return out


def hashed_features(batch: pa.RecordBatch, h: np.ndarray, n: np.ndarray, p: Quality) -> list[tuple[np.ndarray, np.ndarray]]:
    """(feature numbers, rows) of the words and of the character n-grams; each kind has numbers of its own."""
    size = U64(1 << p.bits)
    cp, at = code_points(texts_of(batch))
    row = np.repeat(np.arange(batch.num_rows), np.diff(at))
    words = (mix(h) % size).astype(np.int32), np.repeat(np.arange(batch.num_rows), n)
    c = cp.astype(U64)
    m = max(0, len(c) - p.chars + 1)
    g = np.zeros(m, U64)
    for j in range(p.chars):
        g = g * U64(0x9E3779B97F4A7C15) + c[j : m + j] + U64(1)
    same = row[:m] == row[p.chars - 1 :][:m]
    return [words, ((mix(g[same]) % size + size).astype(np.int32), row[:m][same])]


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def raw(self, feats: list[tuple[np.ndarray, np.ndarray]], rows: int) -> np.ndarray:
        z = np.full(rows, self.bias)
        for f, r in feats:
            z += np.bincount(r, self.weights[f], rows) / np.maximum(np.bincount(r, minlength=rows), 1)
        return z

    def probability(self, feats: list, rows: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(feats, rows) + self.shift, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, params: Quality = Quality()) -> Model | None:
    """Learns from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality 0 or 1), half of the sample from either
    quality. None if there are not both."""
    p = params
    rows, per = labelled_sample(docs, labels, "quality", p.rows, balanced=True, chars=p.code_points)
    if set(per) != {0, 1} or rows.select("quality").distinct().count() < 2:
        return None
    kinds = "y int, o long, f array<int>, v array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            c = base_counts(batch, p)
            key, val = [], []
            for f, r in hashed_features(batch, c["hashes"], c["n_words"], p):
                pair, count = np.unique(r.astype(np.int64) << 32 | f, return_counts=True)
                total = np.bincount(r, minlength=batch.num_rows)
                key.append(pair)
                val.append(count / total[pair >> 32])
            key, val = np.concatenate(key), np.concatenate(val)
            order = np.argsort(key, kind="stable")
            at = np.searchsorted(key[order] >> 32, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("quality").cast(pa.int32()), batch.column("order"), pa.ListArray.from_arrays(at, pa.array((key[order] & 0xFFFFFFFF).astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(val[order].astype(np.float32)))],
                names=["y", "o", "f", "v"],
            )

    got = rows.select("text", "quality", "order").mapInArrow(run, kinds).toArrow().sort_by("o")
    f, v = got.column("f").combine_chunks(), got.column("v").combine_chunks()
    y, at = got.column("y").to_numpy().astype(float), f.offsets.to_numpy()
    r, feat, val = np.repeat(np.arange(len(y)), np.diff(at)), f.flatten().to_numpy(), v.flatten().to_numpy().astype(float)
    used, feat = np.unique(feat, return_inverse=True)

    def fitted(rows: np.ndarray) -> tuple[np.ndarray, float]:
        """Weights of the used features, and bias, by Adam on all of these rows at once."""
        mine = rows[r]
        rr, ff, vv = r[mine], feat[mine], val[mine]
        balance = rows * np.where(y > 0, 0.5 / max(y[rows].mean(), 1e-9), 0.5 / max(1 - y[rows].mean(), 1e-9))
        balance = balance / max(balance.sum(), 1e-9)
        w, bias, m1, m2 = np.zeros(len(used)), 0.0, np.zeros(len(used)), np.zeros(len(used))
        for t in range(1, p.steps + 1):
            z = bias + np.bincount(rr, w[ff] * vv, len(y))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * balance
            grad = np.bincount(ff, vv * g[rr], len(w)) + 1e-6 * w
            m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
            w -= 0.3 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-9)
            bias -= 0.5 * g.sum()
        return w, bias

    # each half is scored by the model of the other half: what the calibration sees, no model has learned
    half, z = got.column("o").to_numpy() % 2 == 0, np.zeros(len(y))
    for rows in (half, ~half) if len(set(y[half])) == len(set(y[~half])) == 2 else ():
        w, bias = fitted(rows)
        z = np.where(rows, z, bias + np.bincount(r, w[feat] * val, len(y)))
    w, bias = fitted(np.ones(len(y), bool))
    if not z.any():
        z = bias + np.bincount(r, w[feat] * val, len(y))
    shift, slope = logistic(z[:, None], y, l2=1e-3)
    prior = per[1] / (per[0] + per[1])
    shift += np.log(prior / (1 - prior)) - np.log(max(y.mean(), 1e-3) / max(1 - y.mean(), 1e-3))
    weights = np.zeros(2 << p.bits, np.float32)
    weights[used] = w
    return Model(weights, bias, float(slope), float(shift))


def judged(docs: DataFrame, model: Model | None, params: Quality = Quality()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, quality_score, kept.

    Null and empty texts count 0 throughout and fail the rules. Without a model the rules decide alone. One row in, one
    row out, so null and repeated ids stay as they are; extra columns are ignored.
    """
    p, shared = params, docs.sparkSession.sparkContext.broadcast(model)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            c = base_counts(batch, p)
            failed = (c["n_words"] < p.min_words) | (100 * c["n_repeat_words"] > p.max_repeat_percent * c["n_words"])
            m = shared.value
            score = np.ones(batch.num_rows) if m is None else m.probability(hashed_features(batch, c["hashes"], c["n_words"], p), batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c[x]) for x in names), pa.array(failed), pa.array(score), pa.array(~failed & (score >= p.threshold))],
                names=["doc_id", *names, "base_failed", "quality_score", "kept"],
            )

    kinds = "doc_id long, " + ", ".join(f"{x} long" for x in names) + ", base_failed boolean, quality_score double, kept boolean"
    return docs.select("doc_id", "text").mapInArrow(run, kinds)
