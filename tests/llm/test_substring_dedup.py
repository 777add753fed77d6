import hashlib
import random

import pytest

from evalspark.llm.substring_dedup import SubstringDedup, substring_dedup


def brute(docs, window):
    starts = {}
    words = [(i, (t or "").encode().split()) for i, t in docs]
    for i, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            starts[key] = min(starts.get(key, i), i)
    out = {}
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if starts[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def found(df, p):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup(df, p).collect()}


def passages():
    rng = random.Random(3)
    parts = [[f"w{rng.randrange(60)}" for _ in range(rng.randrange(20, 90))] for _ in range(12)]
    return [" ".join(sum((rng.choice(parts) for _ in range(rng.randrange(0, 5))), [f"x{i}"] * rng.randrange(0, 3))) for i in range(80)]


@pytest.mark.parametrize("rows,sort_windows,run", [(20_000, 1 << 19, 256), (20_000, 50, 7), (1, 1 << 19, 256)])
def test_against_all_windows(table, rows, sort_windows, run):
    """In one place, in many small places, and with every bucket dealt out window by window."""
    texts = passages()
    p = SubstringDedup(window=25, mer=8, bucket_rows=rows, sort_windows=sort_windows, run=run)
    assert found(table(texts), p) == brute(list(enumerate(texts)), 25)


def test_whole_table(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    assert found(documents, SubstringDedup()) == brute(rows, 50)


def test_edges(table):
    long = " ".join(f"v{i % 211}" for i in range(40_000))
    texts = [None, "", "a " * 49, "a " * 50, "a " * 60, "b c " * 60, long, "x " + long, " \n"]
    assert found(table(texts), SubstringDedup()) == brute(list(enumerate(texts)), 50)
    assert substring_dedup(table([])).count() == 0
    same = found(table([(1, "a " * 60), (1, "a " * 60)]), SubstringDedup())
    assert same[1][1] == 0


@pytest.mark.parametrize("rows", [1, 20_000])
def test_null_and_repeated_ids(spark, rows):
    """Rows of one id are judged by their own texts; a row without an id keeps all words and removes none."""
    texts = passages()
    docs = [(None if i % 7 == 0 else i // 3, t) for i, t in enumerate(texts)] + [(4, texts[12])] * 3
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    named = [(i, t) for i, t in docs if i is not None]
    starts, want = {}, []
    for i, t in named:
        w = t.split()
        for k in range(len(w) - 24):
            key = tuple(w[k : k + 25])
            starts[key] = min(starts.get(key, i), i)
    for i, t in docs:
        w = t.split()
        gone = {k + j for k in range(len(w) - 24) if i is not None and starts[tuple(w[k : k + 25])] < i for j in range(25)}
        want.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    got = substring_dedup(df, SubstringDedup(window=25, mer=8, bucket_rows=rows)).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=str) == sorted(want, key=str)
