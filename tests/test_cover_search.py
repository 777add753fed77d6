"""Maximum coverage against trying every subset, and on sets too many to try."""

from itertools import combinations
from math import comb

import numpy as np
import pytest

from evalspark.operators import cover_search, selection
from evalspark.operators.cover_search import Patterns, best_cover, patterns


def frame(spark, table):
    return spark.createDataFrame([(o, p, bool(x)) for o, v in enumerate(table) for p, x in enumerate(v)], "ord long, pos int, solved boolean")


def brute(table, n):
    best = max(combinations(range(len(table)), n), key=lambda s: (table[list(s)].any(0).sum(), [-x for x in s]))
    return list(best), int(table[list(best)].any(0).sum())


def of(table):
    kinds, weight = np.unique(table.T, axis=0, return_counts=True)
    some = kinds.any(1)
    return Patterns(kinds[some], weight[some].astype(float), list(range(len(table))))


@pytest.mark.parametrize("seed", range(6))
def test_against_every_subset(spark, seed):
    """Random tables, sparse ones with many ties, and models that solve nothing."""
    r = np.random.default_rng(seed)
    table = r.random((14, 90)) < (0.02, 0.05, 0.1, 0.3, 0.6, 0.04)[seed]
    table[r.choice(14, 3, replace=False)] = False
    for n in (1, 2, 4, 6):
        assert best_cover(spark, of(table), n) == brute(table, n)


def test_patterns_and_joins_agree(spark):
    r = np.random.default_rng(9)
    table = r.random((9, 200)) < 0.15
    df = frame(spark, table).repartition(3)
    p = patterns(df)
    assert p.weight.sum() == table.any(0).sum() and len(p.weight) == len(np.unique(table.T[table.any(0)], axis=0))
    a, b = selection.optimal_cover(df, 4).first(), selection.every_subset(df, 4).first()
    assert (a["members"], a["covered"]) == (b["members"], b["covered"]) == brute(table, 4)
    assert patterns(df, cells=100) is None


def test_waves_give_the_same(spark, monkeypatch):
    """A budget of few nodes: subtrees go through several waves of tasks."""
    monkeypatch.setattr(cover_search, "BUDGET", 0)
    r = np.random.default_rng(4)
    table = r.random((16, 120)) < 0.12
    p = of(table)
    monkeypatch.setattr(Patterns, "nodes", property(lambda self: 40))
    assert best_cover(spark, p, 5) == brute(table, 5)


def test_sixty_models_choose_eight(spark):
    """2.6 * 10^9 subsets; eight planted models that share nothing cover most, and the first of two equal models counts."""
    r = np.random.default_rng(6)
    table = r.random((60, 1600)) < 0.04
    planted = [3, 11, 19, 26, 34, 41, 50, 58]
    for k, m in enumerate(planted):
        table[m] = False
        table[m, k * 180 : k * 180 + 170] = True
    table[45] = table[11]
    assert comb(60, 8) > 2_500_000_000
    got = selection.optimal_cover(frame(spark, table), 8).first()
    assert got["members"] == planted and got["covered"] == 8 * 170


def test_more_than_one_word_of_models(spark):
    table = np.zeros((70, 70), bool)
    table[np.arange(70), np.arange(70)] = True
    table[69, :30] = True
    got = selection.optimal_cover(frame(spark, table), 3).first()
    assert got["covered"] == 33 and got["members"] == [30, 31, 69]
    assert selection.optimal_cover(frame(spark, table[:2]), 3).count() == 0
