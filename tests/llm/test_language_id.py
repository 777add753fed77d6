import math
from collections import Counter

import numpy as np

from evalspark.llm.common import held_out
from evalspark.llm.language_id import LanguageId, Model, identify, predicted, train


def test_probabilities_sum_to_one_and_follow_the_definition():
    """The interpolated Kneser-Ney estimate, worked out with dictionaries."""
    text = "abracadabra abba cab"
    order = 3
    seq = [32] * (order - 1) + [ord(c) for c in text]
    count = Counter(tuple(seq[i : i + order]) for i in range(len(seq) - order + 1))
    grams = np.array(list(count), np.int32)
    m = Model.fit(["x"], np.zeros(len(grams), np.int64), grams, np.array(list(count.values())))
    levels = [count]
    for _ in range(order - 1):
        levels.append(Counter(g[1:] for g in levels[-1]))
    levels = levels[::-1]  # levels[0]: unigram continuation counts
    alphabet = sorted({c for c in seq[order - 1 :]})
    size = len(alphabet) + 1

    def p(k, gram):
        if k == 0:
            return 1 / size
        c = levels[k - 1]
        ones, twos = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = min(max(ones / (ones + 2 * twos) if ones else 0.5, 0.1), 0.9)
        ctx = gram[:-1]
        total = sum(v for g, v in c.items() if g[:-1] == ctx)
        if not total:
            return p(k - 1, gram[1:])
        kinds = sum(g[:-1] == ctx for g in c)
        return max(c[gram] - d, 0) / total + d * kinds / total * p(k - 1, gram[1:])

    for ctx in ((32, 32), (ord("a"), ord("b")), (ord("z"), ord("a"))):
        x = np.array([[*ctx, c] for c in alphabet], np.uint32).ravel()
        got = m.scores(x, np.arange(len(alphabet)) * 3 + 2)[:, 0]
        want = [math.log(p(order, (*ctx, c))) for c in alphabet]
        assert np.allclose(got, want, atol=1e-5)
        assert abs(np.exp(got).sum() - (1 - math.exp(got.min()) * 0) ) < 1 / size + 1e-6


def test_held_out_accuracy(documents):
    got = identify(documents.select("doc_id", "text", "lang")).where(held_out()).toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.95
    assert got["lang_score"].between(0, 1).all() and not got["rejected"].any()


def test_edges(table, documents, spark):
    model = train(documents)
    rows = {r["doc_id"]: r for r in predicted(table([None, "", "1234 !?", "the and of", "x" * 100_000, "鿕鿖鿗 鿘鿙鿚鿛鿜鿝" * 9]), model).collect()}
    assert [rows[i]["lang_pred"] for i in range(3)] == ["und"] * 3
    assert all(rows[i]["rejected"] for i in (0, 1, 2, 5)) and rows[0]["lang_score"] == 0.0 and rows[0]["cross_entropy"] is None
    assert not rows[3]["rejected"] and rows[4]["rejected"]
    assert train(table([])) is None
    assert train(table([None, ""])) is None
    empty = predicted(table(["text"]), None).first()
    assert empty["lang_pred"] == "und" and empty["rejected"]
    one = train(table(["only one language here"] * 3), LanguageId())
    assert predicted(table(["some text"]), one).first()["lang_pred"] == "en"
    assert predicted(table([]), model).count() == 0


def test_gibberish_and_an_unlearned_language_are_rejected(spark, sf_dir):
    rng = np.random.default_rng(3)
    docs = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet").select("doc_id", "text", "lang")
    letters = list("abcdefghijklmnopqrstuvwxyz")
    noise = [(10**6 + i, " ".join("".join(rng.choice(letters, rng.integers(2, 9))) for _ in range(n)), None) for i, n in enumerate([2, 5, 20, 200, 2000] * 4)]
    rows = docs.unionByName(spark.createDataFrame(noise, docs.schema))
    got = predicted(rows, train(docs.where(~held_out() & (docs.lang != "fr")))).toPandas()
    n = got["text"].str.len()
    assert got[(got["doc_id"] >= 10**6)]["rejected"].all()
    assert got[(got["lang"] == "fr") & (n > 300)]["rejected"].mean() > 0.95
    clean = got[got["lang"].isin(["de", "en", "es"]) & (got["doc_id"] < 10**6)]
    assert clean["rejected"].mean() < 0.003
    got = identify(docs).toPandas()
    assert got[got["lang"].notna()]["rejected"].mean() < 0.003


def test_all_grams_count_wherever_they_are_held(documents):
    """Few n-grams sent and the rest met by joins: the scores are those of a model of all n-grams."""
    docs = documents.select("doc_id", "text", "lang").where("doc_id % 4 = 0 or doc_id < 20")
    more = docs.unionByName(docs.limit(3)).unionByName(docs.limit(1).selectExpr("doc_id", "'qqzzxw \u9fd5\u9fd6 wxq' AS text", "lang"))
    whole, few, none = (predicted(more, train(docs, LanguageId(grams=g))).orderBy("doc_id", "text").toPandas() for g in (600_000, 3000, 0))
    for got in (few, none):
        assert np.allclose(whole["cross_entropy"].fillna(-1), got["cross_entropy"].fillna(-1), atol=1e-4)
        assert (whole[["doc_id", "lang_pred", "rejected"]] == got[["doc_id", "lang_pred", "rejected"]]).all(axis=None)


def test_more_than_64_languages(spark):
    texts = [(i, f"{chr(0x4E00 + i) * 5} {chr(0x5E00 + i)}" * 4, f"l{i:03d}") for i in range(70)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    assert predicted(docs, train(docs)).where("lang <> lang_pred").count() == 0


def test_memory_of_many_languages():
    """The most n-grams that are sent with 64 languages: under 600 MB to fit, under 100 MB to send."""
    import pickle
    import tracemalloc

    import numpy as np

    p, r = LanguageId(), np.random.default_rng(1)
    size = p.grams * p.languages // 64
    grams = np.unique(r.integers(97, 123, (size * 2, p.order)), axis=0)
    grams = grams[r.permutation(len(grams))[:size]].astype(np.int32)
    tracemalloc.start()
    model = Model.fit([f"l{i}" for i in range(64)], r.integers(0, 64, len(grams)), grams, r.integers(1, 50, len(grams)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(grams) > 100_000 and peak < 600 << 20 and len(pickle.dumps(model)) < 100 << 20


def test_ids_of_any_kind(table, documents):
    """Null and repeated ids are rows like others, judged by their own texts."""
    model = train(documents.where(~held_out()))
    text = documents.where("lang = 'de'").select("text").first()[0]
    rows = predicted(table([(None, text), (3, text), (3, None), (None, "")]).select("doc_id", "text"), model).collect()
    assert sorted((str(r["doc_id"]), r["lang_pred"]) for r in rows) == [("3", "de"), ("3", "und"), ("None", "de"), ("None", "und")]
