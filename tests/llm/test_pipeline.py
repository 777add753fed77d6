import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from pathlib import Path

import corpus_pipeline as c
import numpy as np
import pytest

from evalspark.llm import queries
from evalspark.llm.language_id import LanguageId
from evalspark.llm.sentencepiece import vocabulary
from evalspark.sources.tables import scratch
from tests.compare import connection, rows
from tests.llm.test_mixing import water
from tests.llm.test_near_dedup import brute as near_groups
from tests.llm.test_sentencepiece import best_score, score


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, sf_dir, name):
    assert rows(queries.QUERIES[name](spark, sf_dir).toPandas()) == rows(connection(sf_dir).sql(queries.ORACLES[name]).df())


def test_stages_keep_the_columns_of_documents(spark, documents, sf_dir):
    docs, counts = documents, [documents.count()]
    for _name, stage in c.STAGES:
        out = stage(spark, docs, sf_dir)
        if (_name, stage) != c.STAGES[-1]:
            assert out.dtypes == docs.dtypes
        docs = out
        counts.append(docs.count())
    assert counts[1] == counts[0] and counts[2] < counts[1] and counts[3] <= counts[2]
    assert docs.where("not exact").count() == 0 and c.run(spark, sf_dir).count() == counts[-1]


def test_edges(spark, table, sf_dir):
    texts = [None, "", "1234", "the first text about something that is long enough to be kept by all stages", "the first text about something that is long enough to be kept by all stages"]
    docs = table(texts, extra=False).unionByName(table([(3, texts[3])], extra=False))
    for _name, stage in c.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
    assert {r["text"] for r in docs.collect()} <= {texts[3], *(" ".join(texts[3].split()[:n]) for n in range(1, 16))}
    empty = table([], extra=False)
    for _name, stage in c.STAGES:
        empty = stage(spark, empty, sf_dir)
    assert empty.count() == 0


CLASHES = ["cut", "words", "rejected", "lang_score", "lang_pred", "cross_entropy", "copy", "taken", "size", "kept", "component_id", "touched", "version", "ranges", "rest", "text_", "n_words", "rep", "bucket", "key", "target", "short"]


def test_columns_with_names_used_inside(spark, documents, sf_dir):
    """Every stage leaves other columns alone, whatever their names, and judges as without them."""
    docs = documents.selectExpr("*", *(f"concat('{c}', doc_id) AS `{c}`" for c in CLASHES))
    for _name, stage in c.STAGES[:-1]:
        got = stage(spark, docs, sf_dir)
        assert got.columns == docs.columns and got.where(" OR ".join(f"`{x}` IS DISTINCT FROM concat('{x}', doc_id)" for x in CLASHES)).count() == 0
        plain = stage(spark, documents, sf_dir)
        assert rows(got.select(*documents.columns).toPandas()) == rows(plain.toPandas())


def test_null_and_repeated_ids(spark, sf_dir):
    long = " ".join(f"the word {i} of a long text" for i in range(30))
    other = " ".join(f"another story with {i} parts and pieces" for i in range(30))
    rows_ = [(None, long), (None, long), (5, long), (5, long), (5, other), (7, other), (9, long + " and one more"), (11, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows_], "doc_id long, text string, lang string, source string, n_chars long")
    kept = c.near_dedup(spark, docs, sf_dir)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [11, 5, None, None]
    assert c.near_dedup(spark, docs.repartition(5), sf_dir).where("doc_id = 5").first() == kept.where("doc_id = 5").first()
    cut = c.substrings(spark, docs, sf_dir)
    assert cut.where("doc_id is null").count() == 2 and cut.where("doc_id = 5").count() == 3 and cut.where("doc_id = 7").count() == 0
    mixed = c.mix(spark, docs, sf_dir)
    assert mixed.where("doc_id is null").count() >= 2
    assert c.language_id(spark, docs.union(docs.where("doc_id = 7")), sf_dir).columns == docs.columns


def test_mix_repeats_and_cuts(spark, documents, sf_dir):
    from pyspark.sql import functions as F

    from evalspark.llm.common import WORD
    from evalspark.llm.mixing import mixed

    out = c.mix(spark, documents, sf_dir)
    got = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit(WORD))).alias("n")).collect()}
    assert got == {r["doc_id"]: r["taken"] for r in mixed(documents).where("taken > 0").collect()}
    assert out.where("n_chars <> length(text)").count() == documents.join(out.select("doc_id"), "doc_id", "left_semi").where("n_chars <> length(text)").count()


def plain_letters(text):
    out = []
    for ch in text or "":
        low = (ch.lower() if len(ch.lower()) == 1 else ch) if ch.isalpha() else " "
        if low != " " or (out and out[-1] != " "):
            out.append(low)
    return out


def plain_languages(docs, p=LanguageId()):
    """Stage 1 with dictionaries: interpolated Kneser-Ney by its definition, limits from the documents that teach."""
    learned = [d for d in docs if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 3 != 1 and d[1] is not None and d[2] is not None]
    assert max(Counter(d[2] for d in learned).values()) < p.few  # so none is left out of training
    names, top = sorted({d[2] for d in learned}), defaultdict(Counter)
    for _, text, lang, _ in learned:
        x = [" "] * (p.order - 1) + plain_letters(text)
        top[lang].update(tuple(x[i : i + p.order]) for i in range(len(x) - p.order + 1))
    levels = {n: [top[n]] for n in names}
    for n in names:
        for _ in range(p.order - 1):
            levels[n].insert(0, Counter(g[1:] for g in levels[n][0]))
    base = 1 / (len({g for n in names for g in levels[n][0]}) + 1)
    less, total, kinds = {}, defaultdict(int), Counter()
    for n in names:
        for k, level in enumerate(levels[n]):
            ones, twos = (sum(v == m for v in level.values()) for m in (1, 2))
            less[n, k] = min(max(ones / (ones + 2 * twos) if ones else 0.5, 0.1), 0.9)
            for g, v in level.items():
                total[n, g[:-1]] += v
                kinds[n, g[:-1]] += 1

    def probability(n, gram):
        out = base
        for k in range(p.order):
            g = gram[p.order - 1 - k :]
            if total.get((n, g[:-1])):
                out = (max(levels[n][k][g] - less[n, k], 0) + less[n, k] * kinds[n, g[:-1]] * out) / total[n, g[:-1]]
        return out

    def entropies(text):
        x = [" "] * (p.order - 1) + plain_letters(text)
        grams = [tuple(x[i : i + p.order]) for i in range(len(x) - p.order + 1)]
        return [-sum(math.log(probability(n, g)) for g in grams) / len(grams) for n in names] if grams else None, len(grams)

    own = [(names.index(d[2]), *entropies(d[1])) for d in learned]
    own = [(k, e[k], n) for k, e, n in own if n]
    usual = [np.median([e for j, e, _ in own if j == k]) for k in range(len(names))]
    slack = max(p.slack + p.margin, 2 * np.quantile([e - usual[k] - p.spread / math.sqrt(n) for k, e, n in own], 0.99))
    kept = []
    for i, text, lang, source in docs:
        e, n = entropies(text)
        if n and min(e) <= usual[e.index(min(e))] + slack + p.spread / math.sqrt(n):
            kept.append((i, text, names[e.index(min(e))] if lang is None else lang, source))
    return kept


def plain_near_dedup(docs):
    groups = near_groups([d[:2] for d in docs if d[0] is not None], 5)
    return [d for d in docs if d[0] is None or groups[d[0]][1] == d[0]]


def plain_substrings(docs, window=50):
    first, kept = {}, []
    cut = [(d, d[1].encode().split()) for d in docs]
    for (i, *_), w in cut:
        for k in range(len(w) - window + 1 if i is not None else 0):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    for (i, text, lang, source), w in cut:
        gone = {j for k in range(len(w) - window + 1 if i is not None else 0) if first[tuple(w[k : k + window])] < i for j in range(k, k + window)}
        left = b" ".join(x for j, x in enumerate(w) if j not in gone).decode() if gone else text
        if not gone or left:
            kept.append((i, left, lang, source))
    return kept


def plain_mix(docs):
    sources = defaultdict(list)
    for i, text, _, source in docs:
        key = hashlib.md5(text.encode()).hexdigest() if i is None else str(i)
        sources[source].append((hashlib.md5(f"mix|{key}".encode()).hexdigest(), i, text, text.encode().split()))
    names = sorted(sources, key=lambda s: (s is None, s or ""))
    sizes = [sum(len(w) for *_, w in sources[s]) for s in names]
    out = []
    for s, size, target in zip(names, sizes, water(sizes, [Fraction((5, 2, 1)[k % 3]) for k in range(len(names))], Fraction(3, 2) * sum(sizes)), strict=True):
        left = math.floor(target)
        while left and size:
            for _, i, text, w in sorted(sources[s], key=lambda r: r[0]):
                if w and left:
                    out.append((i, text if len(w) <= left else " ".join(x.decode() for x in w[:left])))
                    left -= min(left, len(w))
    return out


def planted_documents():
    """Two languages, near and exact copies, chains of them, shared passages of over 50 words, other scripts, no letters."""
    rng = random.Random(8)
    words = {"aa": [rng.choice("bdfgl") + rng.choice("aeo") + rng.choice(["n", "r", "st"]) for _ in range(90)], "bb": [rng.choice("kmpt") + rng.choice("iuy") + rng.choice(["k", "sh", "v"]) + rng.choice("iu") for _ in range(90)]}
    passages = {lang: [" ".join(rng.choice(words[lang]) for _ in range(rng.randrange(55, 90))) for _ in range(3)] for lang in words}
    texts = []
    for _ in range(44):
        lang = rng.choice(["aa", "bb"])
        parts = [" ".join(rng.choice(words[lang]) for _ in range(rng.randrange(5, 120)))]
        if rng.random() < 0.4:
            parts.insert(rng.randrange(2), rng.choice(passages[lang]))
        texts.append((rng.choice(["  ", "\n", " "]).join(parts), lang))
    for _ in range(25):
        text, lang = rng.choice(texts)
        w = text.split()
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(words[lang])
        texts.append((" ".join(w), lang))
    texts += [(p, lang) for lang in words for p in passages[lang][:1]]
    docs = [(i, t, None if rng.random() < 0.1 else lang, rng.choice(["web", "books", None, "code"])) for i, (t, lang) in enumerate(rng.sample(texts, len(texts)), 100)]
    odd = [None, "", "123 !?", "鿕鿖鿗 鿘鿙鿚鿛鿜鿝 " * 9, "qzx" * 60]
    return docs + [(i, t, None, "web") for i, t in enumerate(odd)] + [(None, texts[0][0], "aa", "web"), (None, texts[0][0] + " end", "aa", None)]


def test_run_against_brute_force(spark, tmp_path):
    docs = planted_documents()
    df = spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    by_language = plain_languages(docs)
    near = plain_near_dedup(by_language)
    cut = plain_substrings(near)
    # each step has something to do
    assert len(docs) > len(by_language) > len(near) and near != cut
    order = lambda rows_: sorted(rows_, key=str)
    now = df
    for (name, stage), want in zip(c.STAGES[:3], (by_language, near, cut), strict=True):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        assert order(tuple(r) for r in now.select("doc_id", "text", "lang", "source").collect()) == order(want)
    v = vocabulary(f"{queries.TOKENIZERS}/piece_bpe_32k.model")
    with scratch(spark) as folder:
        got = c.run(spark, str(tmp_path)).collect()
        # only what the last stage reads is left
        assert [x.name for x in Path(folder.removeprefix("file:")).glob("*/*")] == ["004-mix_sources"]
    assert order((r["doc_id"], r["text"]) for r in got) == order(plain_mix(cut))
    for r in got:
        assert r["exact"] and r["n_tokens"] == len(r["ids"])
        assert b"".join(v.pieces[k] for k in r["ids"]).decode() == " " + r["text"]
        assert abs(score(v, r["ids"]) - best_score(v, r["text"])) < 1e-6
