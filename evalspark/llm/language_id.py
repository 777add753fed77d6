"""Language identification with interpolated Kneser-Ney character models.

Texts become lower-case letters with single spaces between words. Spark counts the n-grams of all training documents
of a language; all of them make the models. As many as executors can hold are sorted arrays of n-gram hashes with the
log probabilities of every language, and of context hashes with their back-off weights. Beyond that the models are
tables made by joins and groupings; only the most frequent n-grams are sent, and a text's other n-grams meet the tables
by joins, with the same result. A text gets the language with the lowest cross-entropy per character. A text whose
lowest cross-entropy lies beyond what documents of that language that were left out of training show is rejected.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import U64, Scratch, code_points, hash_share, held_out, letter_table, offsets_of, slices, texts_of

PRIME = 0x9E3779B97F4A7C15
#: Text bytes of one step; a step holds about 150 bytes for each of them.
TEXT_BYTES = 1 << 19
#: Inner columns beside those of the caller.
REST, DIGEST = "__language_rest", "__language_digest"


@dataclass(frozen=True)
class LanguageId:
    order: int = 4
    #: N-grams that executors receive at most, with up to ``languages`` languages; with more languages fewer, so that
    #: n-grams times languages stay below 7.8 million (under 100 MB sent, under 600 MB to fit). The others are met by joins.
    grams: int = 600_000
    languages: int = 13
    #: Documents of each language that calibrate scores and rejection and teach nothing else (a share by hash, about this
    #: many, and no more than a fifth; none of a language with fewer than ``few`` documents).
    calibration: int = 400
    few: int = 50
    #: A text may lie so many nats a letter above its language's own documents, or twice as far as 99 % of them do, ...
    slack: float = 0.75
    #: ... and by this over the root of its number of letters, for chance in short texts.
    spread: float = 3.0
    #: Added to the slack where no documents could be left out of training.
    margin: float = 1.0


def letters(batch: pa.RecordBatch, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all rows with ``order - 1`` spaces before each row; the scored places; the scored places per row.

    Runs of other characters are one space; only letters and the space behind a letter are scored.
    """
    cp, at = code_points(texts_of(batch))
    x = letter_table()[cp]
    n = np.diff(at)
    row = np.repeat(np.arange(len(n)), n)
    keep = x != 32
    keep[1:] |= (x[1:] == 32) & (x[:-1] != 32) & (row[1:] == row[:-1])
    x, row = x[keep], row[keep]
    pad = (order - 1) * (row + 1)
    out = np.full(len(x) + (order - 1) * len(n), 32, np.uint32)
    place = np.arange(len(x)) + pad
    out[place] = x
    return out, place, np.bincount(row, minlength=len(n))


def gram_keys(x: np.ndarray, place: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the 1-, 2-, ..., order-grams that end in each place (polynomials, so prefixes are known too)."""
    power, out, h = 1, [], np.zeros(len(place), U64)
    for k in range(order):
        h = h + (x[place - k].astype(U64) + U64(1)) * U64(power)
        out.append(h)
        power = power * PRIME % 2**64
    return out


def gram_counts(docs: DataFrame, order: int) -> DataFrame:
    """lang, gram (code points, oldest first), n over all documents given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=TEXT_BYTES):
            x, place, n = letters(batch, order)
            lang = batch.column("lang").to_pylist()
            names = sorted(set(lang))
            of = np.repeat(np.array([names.index(v) for v in lang]), n)
            h = gram_keys(x, place, order)[-1]
            for k, name in enumerate(names):
                mine = np.flatnonzero(of == k)
                if not len(mine):
                    continue
                _, first, count = np.unique(h[mine], return_index=True, return_counts=True)
                p = place[mine[first]]
                grams = np.stack([x[p - j] for j in range(order - 1, -1, -1)], 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(p)), pa.FixedSizeListArray.from_arrays(pa.array(grams.ravel()), order).cast(pa.list_(pa.int32())), pa.array(count.astype(np.int64))],
                    names=["lang", "gram", "n"],
                )

    return docs.select("lang", "text").mapInArrow(run, "lang string, gram array<int>, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """For each order sorted hashes of n-grams with log probabilities, and of contexts with log back-off weights."""

    names: list[str]
    order: int
    keys: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]
    floor: np.ndarray
    usual: np.ndarray | None = None
    slack: float = np.inf
    spread: float = 0.0
    scale: float = 1.0
    power: float = 1.0

    @staticmethod
    def fit(names: list[str], lang: np.ndarray, grams: np.ndarray, n: np.ndarray) -> Model:
        """lang: index of the language; grams: rows of code points; n: counts. One row per (language, n-gram)."""
        order, count = grams.shape[1], len(names)
        chars = [grams[:, order - 1 - k].astype(U64) + U64(1) for k in range(order)]  # newest first
        power = [pow(PRIME, k, 2**64) for k in range(order)]
        size = len(np.unique(grams[:, -1])) + 1
        per = []
        rows, c_ = np.arange(len(lang)), n.astype(float)
        for k in range(order, 0, -1):  # from the highest order (counts) down (continuation counts)
            key = sum((chars[j][rows] * U64(power[j]) for j in range(k)), np.zeros(len(rows), U64))
            low = key - chars[k - 1][rows] * U64(power[k - 1])
            per.append((lang[rows], key, key - chars[0][rows], low, c_))
            # the next order counts distinct left neighbours
            order_ = np.lexsort((low, lang[rows]))
            l_, s = lang[rows][order_], low[order_]
            first = np.flatnonzero(np.concatenate([[True], (l_[1:] != l_[:-1]) | (s[1:] != s[:-1])]))
            c_ = np.diff(np.append(first, len(s))).astype(float)
            rows = rows[order_[first]]
        keys, logs, contexts, weights = [], [], [], []
        base = np.full(count, 1.0 / size)
        for k, (l_, key, ctx, low, c_) in zip(range(1, order + 1), reversed(per), strict=True):
            uk, first, ik = np.unique(key, return_index=True, return_inverse=True)
            uc, ic = np.unique(ctx, return_inverse=True)
            cnt = np.zeros((len(uk), count))
            cnt[ik, l_] = c_
            total, kinds = np.zeros((len(uc), count)), np.zeros((len(uc), count))
            np.add.at(total, (ic, l_), c_)
            np.add.at(kinds, (ic, l_), 1)
            ones, twos = np.bincount(l_[c_ == 1], minlength=count), np.bincount(l_[c_ == 2], minlength=count)
            d = np.clip(np.where(ones > 0, ones / np.maximum(ones + 2 * twos, 1), 0.5), 0.1, 0.9)
            lam = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
            of = ic[first]
            lower = np.exp(logs[-1][np.searchsorted(keys[-1], low[first])]) if k > 1 else base
            p = np.maximum(cnt - d, 0) / np.maximum(total[of], 1) + lam[of] * lower
            keys.append(uk)
            logs.append(np.log(p).astype(np.float32))
            contexts.append(uc)
            weights.append(np.log(lam).astype(np.float32))
        return Model(names, order, keys, logs, contexts, weights, np.log(base).astype(np.float32))

    def scores(self, x: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Log probability of the letter in each place, a column per language."""
        h = gram_keys(x, place, self.order)
        out = np.zeros((len(place), len(self.names)), np.float32)
        rows = np.arange(len(place))
        for k in range(self.order - 1, -1, -1):
            key = h[k][rows]
            at = np.minimum(np.searchsorted(self.keys[k], key), len(self.keys[k]) - 1)
            hit = self.keys[k][at] == key
            out[rows[hit]] += self.logs[k][at[hit]]
            rows, key = rows[~hit], key[~hit]
            if not len(rows):
                return out
            ctx = key - (x[place[rows]].astype(U64) + U64(1))
            at = np.minimum(np.searchsorted(self.contexts[k], ctx), len(self.contexts[k]) - 1)
            hit = self.contexts[k][at] == ctx
            out[rows[hit]] += self.weights[k][at[hit]]
        out[rows] += self.floor
        return out

    def limits(self, win: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The cross-entropy beyond which a text of ``n`` letters is unlike the language."""
        return self.usual[win] + self.slack + self.spread / np.sqrt(np.maximum(n, 1))

    def odds(self, e: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Log odds of each language; differences in cross-entropy count by a power of the length."""
        return -(e - e.min(1, keepdims=True)) * (np.maximum(n, 1) ** self.power)[:, None] / self.scale

    def entropies(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy of each row in each language (nats per scored character), and scored characters."""
        x, place, n = letters(batch, self.order)
        out = np.zeros((batch.num_rows, len(self.names)))
        some = n > 0
        if some.any():
            out[some] = -np.add.reduceat(self.scores(x, place).astype(np.float64), offsets_of(n)[:-1][some], axis=0) / n[some, None]
        if REST in batch.schema.names:
            rest = batch.column(REST)
            met = rest.is_valid().to_numpy(zero_copy_only=False)
            out[met] -= rest.drop_null().flatten().to_numpy().reshape(-1, len(self.names)) / n[met, None]
        return out, n


@dataclass
class Head(Model):
    """The most frequent n-grams of the highest order, and the tables that hold all (left behind when this is sent)."""

    grams: list[DataFrame] | None = None
    backoff: list[DataFrame] | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "grams": None, "backoff": None}

    def place_of(self, x: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = gram_keys(x, place, self.order)[-1]
        at = np.minimum(np.searchsorted(self.keys[0], key), len(self.keys[0]) - 1) if len(self.keys[0]) else np.zeros(len(key), np.int64)
        return at, (self.keys[0][at] == key if len(self.keys[0]) else np.zeros(len(key), bool))

    def scores(self, x: np.ndarray, place: np.ndarray) -> np.ndarray:
        """As of ``Model``, but 0 where the n-gram is not among those sent."""
        at, hit = self.place_of(x, place)
        out = np.zeros((len(place), len(self.names)), np.float32)
        out[hit] = self.logs[0][at[hit]]
        return out

    @staticmethod
    def build(counts: DataFrame, names: list[str], order: int, size: int, scratch: Scratch) -> Head:
        """counts: lang, gram, n. The estimate of ``Model.fit``, by groupings and joins; ``size`` n-grams are sent."""
        spark, many = counts.sparkSession, len(names)
        index = spark.createDataFrame(list(zip(names, range(many), strict=True)), "lang string, l int")
        levels = {order: scratch.save(counts.join(F.broadcast(index), "lang").select("l", "gram", F.col("n").cast("double").alias("c")), f"grams{order}")}
        for k in range(order - 1, 0, -1):  # continuation counts: distinct left neighbours
            levels[k] = scratch.save(levels[k + 1].groupBy("l", F.slice("gram", 2, k).alias("gram")).agg(F.count("*").cast("double").alias("c")), f"grams{k}")
        base = 1.0 / (levels[1].select("gram").distinct().count() + 1)
        places = F.sequence(F.lit(0), F.lit(many - 1))
        spread = lambda col: F.map_from_entries(F.collect_list(F.struct("l", col)))
        at = lambda m, i, other: F.coalesce(F.col(m)[i], F.lit(other))
        probs, backoff = [], []
        for k in range(1, order + 1):
            level, d = levels[k], np.full(many, 0.5)
            for r in level.groupBy("l").agg(F.count_if(F.col("c") == 1).alias("ones"), F.count_if(F.col("c") == 2).alias("twos")).collect():
                d[r["l"]] = r["ones"] / (r["ones"] + 2 * r["twos"]) if r["ones"] else 0.5
            less = F.array(*map(F.lit, np.clip(d, 0.1, 0.9).tolist()))
            ctx = F.slice("gram", 1, k - 1)
            sums = level.groupBy(ctx.alias("ctx"), "l").agg(F.sum("c").alias("total"), F.count("*").alias("kinds"))
            sums = sums.groupBy("ctx").agg(spread(F.col("total")).alias("totals"), spread(F.col("kinds") / F.col("total")).alias("spreads"))
            lam = F.transform(places, lambda i: F.coalesce(less[i] * F.col("spreads")[i], F.lit(1.0)))  # noqa: B023
            held = scratch.save(sums.select("ctx", F.transform(places, lambda i: at("totals", i, 1.0)).alias("total"), lam.alias("lam")), f"contexts{k}")
            rows = level.groupBy("gram").agg(spread(F.col("c")).alias("m"), F.sum("c").alias("n")).withColumn("ctx", ctx).join(held, "ctx")
            if k > 1:
                rows = rows.withColumn("tail", F.slice("gram", 2, k - 1)).join(probs[-1].select(F.col("gram").alias("tail"), F.col("p").alias("lower")), "tail")
            else:
                rows = rows.withColumn("lower", F.transform(places, lambda i: F.lit(base)))
            p = F.transform(places, lambda i: F.greatest(at("m", i, 0.0) - less[i], F.lit(0.0)) / F.col("total")[i] + F.col("lam")[i] * F.col("lower")[i])  # noqa: B023
            probs.append(scratch.save(rows.select("gram", "n", p.alias("p")), f"probabilities{k}"))
            backoff.append(held)
        # the lowest count of which all n-grams with as many fit
        cut, room = np.inf, size
        for r in probs[-1].groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
            room -= r["count"]
            if room < 0:
                break
            cut = r["n"]
        sent = probs[-1].where(F.col("n") >= F.lit(float(cut))).select("gram", "p").toArrow()
        x = sent.column("gram").combine_chunks().flatten().to_numpy().astype(np.uint32)
        keys = gram_keys(x, np.arange(order - 1, len(x), order), order)[-1] if len(x) else np.zeros(0, U64)
        logs = np.log(sent.column("p").combine_chunks().flatten().to_numpy().reshape(-1, many)).astype(np.float32)
        by = np.argsort(keys)
        return Head(names, order, [keys[by]], [logs[by]], [], [], np.full(many, np.log(base), np.float32), grams=probs, backoff=backoff)

    def with_rest(self, docs: DataFrame) -> DataFrame:
        """``docs`` with the summed log probabilities of the n-grams that are not sent (null if there are none)."""
        shared = docs.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = shared.value
            for batch in slices(batches, limit=TEXT_BYTES):
                x, place, n = letters(batch, m.order)
                row, p = np.repeat(np.arange(len(n)), n), place
                away = ~m.place_of(x, place)[1]
                row, p = row[away], p[away]
                grams = np.stack([x[p - j] for j in range(m.order - 1, -1, -1)], 1).astype(np.int32).reshape(-1, m.order)
                pairs, times = np.unique(np.column_stack([row, grams]), axis=0, return_counts=True)
                gram = pa.FixedSizeListArray.from_arrays(pa.array(pairs[:, 1:].ravel().astype(np.int32)), m.order).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("digest").take(pa.array(pairs[:, 0])), gram, pa.array(times.astype(np.int64))], names=["digest", "gram", "times"])

        texts = docs.where("text is not null").select("text", F.md5("text").alias("digest"))
        # equal texts have equal rows
        away = Scratch(docs.sparkSession).save(texts.mapInArrow(run, "digest string, gram array<int>, times long").distinct(), "away")
        asked, p = away.select("gram").distinct(), None
        for k in range(1, self.order + 1):
            tail, ctx = F.slice("gram", self.order - k + 1, k), F.slice("gram", self.order - k + 1, k - 1)
            asked = asked.withColumns({"tail": tail, "ctx": ctx}).join(self.grams[k - 1].select(F.col("gram").alias("tail"), F.col("p").alias("found")), "tail", "left").join(self.backoff[k - 1].select("ctx", "lam"), "ctx", "left")
            low = F.array(*map(F.lit, np.exp(self.floor.astype(float)).tolist())) if p is None else F.col("p")
            p = F.coalesce("found", F.when(F.col("lam").isNull(), low).otherwise(F.zip_with("lam", low, lambda a, b: a * b)))
            asked = asked.select("gram", p.alias("p"))
        sums = F.array(*(F.sum(F.col("times") * F.ln(F.col("p")[i])) for i in range(len(self.names))))
        rest = away.join(asked, "gram").groupBy("digest").agg(sums.alias(REST)).withColumnRenamed("digest", DIGEST)
        return docs.withColumn(DIGEST, F.md5("text")).join(rest, DIGEST, "left").drop(DIGEST)


def train(docs: DataFrame, params: LanguageId = LanguageId()) -> Model | None:
    """Learns from the rows given (doc_id, text, lang); rows without text or lang teach nothing. None if none does."""
    p = params
    docs = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    scratch = Scratch(docs.sparkSession)
    per = docs.groupBy("lang").count().orderBy("lang").collect()
    if not per:
        return None
    left_out = F.lit(False)
    for r in per:
        if r["count"] >= p.few:
            left_out = left_out | ((F.col("lang") == r["lang"]) & hash_share(min(0.2, p.calibration / r["count"])))
    counts = scratch.save(gram_counts(docs.where(~left_out), p.order), "counts")
    held = {r["lang"]: r["count"] for r in counts.groupBy("lang").count().collect()}
    names = sorted(held)
    if not names:
        return None
    size = p.grams * p.languages // max(p.languages, len(names))
    if sum(held.values()) <= size:
        rows = counts.select("lang", "gram", "n").toArrow()
        lang = np.searchsorted(np.array(names, object), np.array(rows.column("lang").to_pylist(), object)).astype(np.int64)
        grams = rows.column("gram").combine_chunks().flatten().to_numpy().reshape(-1, p.order)
        model = Model.fit(names, lang, grams, rows.column("n").to_numpy())
    else:
        model = Head.build(counts, names, p.order, size, scratch)
    calibrate(model, docs.where(left_out), docs.where(hash_share(min(1.0, p.calibration * len(per) / sum(r["count"] for r in per)))), p)
    return model


def calibrate(model: Model, left_out: DataFrame, learned: DataFrame, p: LanguageId) -> None:
    """Sets usual cross-entropies, slack and the odds' scale and power from documents that were left out of training, or
    from learned ones if there are none."""
    names, slack = model.names, p.slack
    for docs in (left_out, learned):
        seen = cross_entropies(docs, model, "lang").toPandas()
        seen = seen[(seen["n"] > 0) & seen["lang"].isin(names)]
        if len(seen):
            break
        slack = p.slack + p.margin
    e, n = np.array(seen["ce"].tolist()).reshape(-1, len(names)), seen["n"].to_numpy().astype(float)
    truth = np.array([names.index(v) for v in seen["lang"]], np.int64)
    own = e[np.arange(len(e)), truth]
    middle = np.median(own) if len(own) else 0.0
    model.usual = np.array([np.median(own[truth == k]) if (truth == k).any() else middle for k in range(len(names))])
    beyond = own - model.usual[truth] - p.spread / np.sqrt(n)
    model.slack, model.spread = (max(slack, 2 * float(np.quantile(beyond, 0.99))) if len(own) else np.inf), p.spread
    best = []
    for power, scale in itertools.product((0.25, 0.5, 0.75, 1.0), np.geomspace(0.01, 20, 30)):
        model.power, model.scale = power, scale
        q = np.exp(model.odds(e, n))
        q /= q.sum(1, keepdims=True)
        best.append((-np.log(np.maximum(q[np.arange(len(q)), truth], 1e-6)).sum(), power, scale))
    _, model.power, model.scale = min(best)


def cross_entropies(docs: DataFrame, model: Model, *extra: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=TEXT_BYTES):
            e, n = shared.value.entropies(batch)
            ce = pa.FixedSizeListArray.from_arrays(pa.array(e.ravel()), e.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in extra), ce, pa.array(n)], names=[*extra, "ce", "n"])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in extra)
    docs = docs.select("text", *extra)
    return (model.with_rest(docs) if isinstance(model, Head) else docs).mapInArrow(run, kinds + "ce array<double>, n long")


def predicted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` with lang_pred, lang_score (0 to 1), cross_entropy and rejected.

    A text that is null or has no letter gets ``und``, score 0 and is rejected, as does every text if there is no
    model. Ties go to the language that comes first by name. All columns of ``docs`` but these stay as they are; null
    and repeated ids are rows like others.
    """
    docs = docs.drop("lang_pred", "lang_score", "cross_entropy", "rejected")
    if model is None:
        return docs.select("*", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("lang_score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, limit=TEXT_BYTES):
            e, n = m.entropies(batch)
            win = e.argmin(1)
            low = e[np.arange(len(e)), win]
            z = np.exp(m.odds(e, n.astype(float)))
            none = n == 0
            label = [("und" if u else m.names[k]) for u, k in zip(none, win, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(label, pa.string()), pa.array(np.where(none, 0.0, 1 / z.sum(1))), pa.array(low, mask=none), pa.array(none | (low > m.limits(win, n)))],
                names=[*columns, "lang_pred", "lang_score", "cross_entropy", "rejected"],
            )

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in columns)
    return (model.with_rest(docs) if isinstance(model, Head) else docs).mapInArrow(run, kinds + "lang_pred string, lang_score double, cross_entropy double, rejected boolean")


def identify(docs: DataFrame, params: LanguageId = LanguageId()) -> DataFrame:
    """Learns from the rows outside the held-out fold and predicts all rows."""
    return predicted(docs, train(docs.where(~held_out()), params))
