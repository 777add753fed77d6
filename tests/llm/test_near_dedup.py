import random

import numpy as np
import pytest

from evalspark.llm.common import Scratch
from evalspark.llm.near_dedup import NearDedup, components, intersections, near_duplicates, superminhash


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(docs, k, percent=80):
    """Smallest reachable id of every document, by comparing all pairs."""
    sets = {i: shingles(t, k) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def found(df, p):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(df, p).collect()}


@pytest.mark.parametrize("k", [2, 5])
def test_whole_table_against_all_pairs(documents, k):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    assert found(documents, NearDedup(shingle_words=k)) == brute(rows, k)


@pytest.mark.parametrize("limits", [{}, {"list_rows": 1, "block_shingles": 500}, {"list_rows": 8}])
def test_group_of_near_copies(table, limits):
    """A template with many variants, some too far from the centre but near another variant, in several blocks."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    texts = [" ".join(base)]
    for _ in range(70):
        w = list(rng.choice(texts).split())
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10_000)}"
        texts.append(" ".join(w))
    rng.shuffle(texts)
    got = found(table(texts), NearDedup(shingle_words=2, **limits))
    assert got == brute(list(enumerate(texts)), 2)


def test_many_outside_the_central_component(table):
    """Buckets with a third of the table outside their central component: a template whose slots differ too much."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for group in range(40):
        own = [f"g{group}x{i}" for i in range(30)]
        for _ in range(4):
            w = base[:]
            for i, x in enumerate(own):
                w[i * 6] = x
            w[rng.randrange(200)] = f"y{rng.randrange(10_000)}"
            texts.append(" ".join(w))
    texts += [f"another text number {i} of its own" for i in range(160)]
    # bands of one row put every pair of the template into common buckets
    got = found(table(texts), NearDedup(shingle_words=2, bands=8, rows=1))
    want = brute(list(enumerate(texts)), 2)
    assert got == want and len({c for _, c in want.values()}) > 40


def test_edges(table, spark):
    texts = [None, "", " \n\t ", "one", "One", "one two", "a b", "ONE TWO", "long " * 30_000, "long " * 30_000]
    got = found(table(texts), NearDedup(shingle_words=2))
    assert got == brute(list(enumerate(texts)), 2)
    assert got[0] == (0, 0) and got[1] == (0, 1) and got[4] == (1, 3) and got[7] == (1, 5)
    again = found(table([(3, "a b c"), (3, "a b c"), (1, "a b c")]), NearDedup())
    assert again == {3: (1, 1), 1: (1, 1)}
    assert near_duplicates(table([]), NearDedup()).count() == 0


def test_null_and_repeated_ids(spark):
    """An id with several texts is linked by any of them; rows without an id by none."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(50)) for x in "abc")
    rows = [(9, a), (9, b), (3, b), (4, a + " more"), (2, c), (9, b), (None, a), (None, c), (1, None), (1, c), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted({(r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(df, NearDedup(shingle_words=2)).collect()}, key=str)
    assert got == sorted({(9, 3, False), (3, 3, True), (4, 3, False), (2, 1, False), (1, 1, True), (6, 6, True), (None, None, True)}, key=str)
    assert near_duplicates(df).count() == len(rows)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 102), (102, 101)], "u long, v long").repartition(7)
    got = {r["u"]: r["v"] for r in components(edges, Scratch(spark)).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100, 102: 100}


def test_signature_estimates_similarity_and_stops_early():
    rng = np.random.default_rng(0)
    for n, shared in ((1, 1), (4, 2), (60, 40), (3000, 2600)):
        seen = []
        for _ in range(20):
            u = rng.integers(0, 2**63, 2 * n - shared, dtype=np.uint64)
            s = superminhash(np.concatenate([u[:n], u[n - shared :]]), np.array([0, n, 2 * n]), 216, 7)
            seen.append((s[0] == s[1]).mean())
        assert abs(np.mean(seen) - shared / (2 * n - shared)) < 0.03
    assert (superminhash(np.zeros(0, np.uint64), np.array([0, 0]), 8, 1) == np.iinfo(np.uint64).max).all()


def test_intersections():
    rng = np.random.default_rng(1)
    a, b = ([np.unique(rng.integers(0, 90, rng.integers(0, 40))) for _ in range(n)] for n in (5, 9))
    flat = lambda x: (np.concatenate(x), np.concatenate([[0], np.cumsum([len(y) for y in x])]))
    want = [[len(np.intersect1d(x, y)) for y in b] for x in a]
    assert intersections(*flat(a), *flat(b), columns=7).tolist() == want
