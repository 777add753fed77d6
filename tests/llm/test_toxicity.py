import itertools

import numpy as np
from pyspark.sql import functions as F

from evalspark.llm.common import held_out
from evalspark.llm.toxicity import Automaton, Tokens, Toxicity, candidate_terms, scored, train


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def met(words, a):
    chars = np.array([ord(c) for w in words for c in w], np.uint32)
    size = np.array([len(w) for w in words])
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    state = a.walk(Tokens(chars, begin, size, np.zeros(len(words), int), np.zeros(len(words), bool)))
    return [(int(a.hit[s]) >= 0, int(a.edits[s])) for s in state]


def test_automaton_accepts_what_is_within_one_edit():
    p = Toxicity()
    terms = [("abcab", 1.0), ("bac", 1.0), ("abbca", 2.0), ("caab*", 1.0), ("bbcacb*", 1.0)]
    a = Automaton.build(terms, p)
    words = ["".join(w) for n in range(1, 8) for w in itertools.product("abcx", repeat=n)][:9000] + ["caabxyzzy", "bbcacbzz", "bbcxcbzz", "zbbcacbq"]
    for w, (hit, edits) in zip(words, met(words, a)):
        best = []
        for t, _ in terms:
            stem = t.rstrip("*")
            fuzzy = len(stem) >= (p.fuzzy_stem if t != stem else p.fuzzy_word)
            ends = [w[:k] for k in range(len(w) + 1)] if t != stem else [w]
            d = min(distance(stem, e) for e in ends)
            if d <= (1 if fuzzy else 0):
                best.append(d)
        assert hit == bool(best) and (not best or edits == min(best)), (w, hit, edits, best)


def test_held_out(spark):
    sf_dir = "/root/testdata/sf0.01"
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = scored(documents, train(documents, labels.where(~held_out()))).join(labels.where(held_out()), "doc_id").toPandas()
    good = got[got["quality"] == 1]
    assert len(good) > 10 and (good["predicted"] == good["toxic"]).mean() > 0.9
    assert got["score"].between(0, 1).all()


def corpus(table):
    texts = [f"you are a horrid{'ly' * (i % 2)} fool number {i} here" if i % 4 == 0 else f"plain words about number {i} and more" for i in range(80)]
    docs = table(texts)
    return docs, docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))


def test_misspelling_and_quotation(table):
    model = train(*corpus(table))
    got = {r["doc_id"]: r for r in scored(table(["you are a horrid fool here", "you are a horid fol here", "plain words about more", None, "", "he said \"horrid fool\" about it"]), model).collect()}
    assert got[0]["predicted"] == 1 and got[1]["score"] > got[2]["score"] and got[2]["predicted"] == 0
    assert got[3]["score"] == got[4]["score"] and 0 <= got[3]["score"] < 0.7


def test_edges(table):
    none = train(table([]), table([]).select("doc_id", F.lit(1).alias("toxic")))
    assert scored(table(["a"]), none).first()["predicted"] == 0
    bad = table(["bad word"] * 6)
    every = train(bad, bad.select("doc_id", F.lit(1).alias("toxic")))
    assert 0 <= scored(table(["a"]), every).first()["score"] <= 1
    assert scored(table([]), every).count() == 0
    long = scored(table(["fool " * 50_000, None]), train(*corpus(table))).collect()
    assert len(long) == 2


def test_copies_do_not_crowd_out_terms(table):
    """A toxic text with many copies and many words of its own, next to terms with small support."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    own = [f"{x}{y}{z}unusual" for x in letters for y in letters[:25] for z in "qx"]
    terms = [f"{x}{y}nasty" for x in letters for y in letters[:20]]
    texts = [" ".join(own)] * 30 + [f"they said {w} number {k}" for w in terms for k in range(4)] + [f"plain words {i}" for i in range(8000)]
    docs = table(texts)
    bad = 30 + 4 * len(terms)
    rows = docs.select("text", (F.col("doc_id") < bad).cast("long").alias("toxic"))
    found = {t for t, _ in candidate_terms(rows, Toxicity())}
    assert all(w in found or any(t.endswith("*") and w.startswith(t[:-1]) for t in found) for w in terms)
    assert not any(w in found for w in own)


def test_whole_words_and_their_extensions_are_all_met(table):
    words = ["hate"] * 9 + ["hateful"] * 5 + ["hater"] * 4 + ["scumbag"] * 9 + ["scum"] * 4 + ["vile"] * 5
    texts = [f"they {w} number {i}" for i, w in enumerate(words)] + [f"plain {w} {i}" for i in range(30) for w in ("words", "scumpole", "vileda")]
    docs = table(texts)
    terms = candidate_terms(docs.select("text", (F.col("doc_id") < len(words)).cast("long").alias("toxic")), Toxicity())
    got = dict(zip([*dict.fromkeys(words), "scumpole", "vileda", "words"], met([*dict.fromkeys(words), "scumpole", "vileda", "words"], Automaton.build(terms, Toxicity()))))
    assert all(got[w] == (True, 0) for w in set(words)), (terms, got)
    assert not any(got[w][0] for w in ("scumpole", "vileda", "words"))


def test_a_large_lexicon_of_many_letters_builds_fast():
    """20,000 terms over 3,000 letters: seconds and megabytes, and each term is met exactly and with an edit."""
    import pickle
    import time

    r = np.random.default_rng(1)
    letters = [chr(0xAC00 + i) for i in range(3000)]
    terms = [("".join(letters[k] for k in r.integers(0, 3000, r.integers(5, 9))) + "*" * int(r.integers(0, 2)), 1.0) for _ in range(20_000)]
    began = time.time()
    a = Automaton.build(terms, Toxicity())
    assert time.time() - began < 10 and len(pickle.dumps(a)) < 100 << 20
    words = [t.rstrip("*") for t, _ in terms[:2000]]
    assert all(h and e == 0 for h, e in met(words, a))
    long = [w for w in words if len(w) >= 6]
    assert all(h for h, _ in met([w[:2] + letters[0] + w[3:] for w in long], a)) and all(h for h, _ in met([w[:3] + w[4:] for w in long], a))
    assert not any(h for h, _ in met(["".join(letters[k] for k in r.integers(0, 3000, 7)) for _ in range(2000)], a))


def test_edits_at_every_place():
    """Every word within one edit of random terms over two letters, against the distance itself; the smallest number counts."""
    r = np.random.default_rng(3)
    p = Toxicity(fuzzy_word=3, fuzzy_stem=4)
    for _ in range(5):
        terms = list({"".join(r.choice(list("ab"), r.integers(2, 7))) + "*" * int(r.integers(0, 2)): 1.0 for _ in range(5)}.items())
        a = Automaton.build(terms, p)
        for w in ("".join(x) for n in range(1, 8) for x in itertools.product("ab", repeat=n)):
            stems = sorted((len(t) - 1, i) for i, (t, _) in enumerate(terms) if t[-1] == "*" and w.startswith(t[:-1]))
            whole = [i for i, (t, _) in enumerate(terms) if t == w]
            near = [i for i, (t, _) in enumerate(terms) if len(t.rstrip("*")) >= (4 if t[-1] == "*" else 3)
                    and min(distance(t.rstrip("*"), e) for e in ([w[:k] for k in range(len(w) + 1)] if t[-1] == "*" else [w])) == 1]
            want = (stems[0][1], 0) if stems else (whole[0], 0) if whole else (min(near), 1) if near else (-1, 0)
            state = a.met(w)
            assert (int(a.hit[state]), int(a.edits[state])) == want, (terms, w)


def test_ids_and_texts_of_any_kind(spark, table):
    """Null and repeated ids are rows like others; null and empty texts score alike; clashing columns do no harm."""
    docs, labels = corpus(table)
    model = train(docs, labels)
    rows = table([(None, "you horrid fool"), (3, "you horrid fool"), (3, "plain words"), (4, None), (5, ""), (None, None), (6, "x" * 300_000)])
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, round(r["score"], 9)) for r in scored(rows, model).collect()))
    by = {}
    for none, i, score in got:
        by.setdefault((none, i), []).append(score)
    assert len(got) == 7 and by[True, 0][1] in by[False, 3] and by[True, 0][0] == by[False, 4][0] == by[False, 5][0] == by[False, 6][0] < 0.5
    assert scored(table([]), model).count() == 0
