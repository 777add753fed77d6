import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from evalspark.llm import prefix_trie as p
from evalspark.llm.common import Scratch
from evalspark.llm.prefix_trie import Trie, prefix_trie, ranked
from evalspark.llm.queries import ORACLES, op11_prefix_trie
from tests.compare import connection, rows

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(turns):
    """From a list of (conv_id, turn, role, text)."""
    own = {}
    for c, turn, role, text in sorted(((c, (t is not None, t or 0), r or "", x or "") for c, t, r, x in turns if c is not None)):
        own.setdefault(c, []).append((role, text))
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    members = {}
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    out = []
    for node, who in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(m[: len(n)] == n and len(m) > len(n) for m in below)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        ends = ",".join(str(c) for c in sorted(who) if len(made[c]) == len(node))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, turns, **params):
    df = spark.createDataFrame(turns, SCHEMA).selectExpr("*", "1 AS n1", "'x' AS part", "2 AS no")
    return sorted((tuple(r) for r in prefix_trie(df, Trie(**params)).collect()), key=str)


@pytest.fixture()
def random_turns():
    r = random.Random(3)
    turns = []
    for c in [*range(60), 10**12 + 3, 10**12]:
        text = r.choice("ab")
        for t in range(r.randint(1, 12)):
            turns.append((c, t, "user" if t % 2 == 0 else "assistant", text if t < 2 else r.choice(["", "é", "x y"])))
    return turns


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    assert rows(op11_prefix_trie(spark, sf).toPandas()) == rows(connection(sf).sql(ORACLES["op11_prefix_trie"]).df())


def test_against_brute_force(spark, random_turns):
    assert got(spark, random_turns, base=100, bucket=7) == brute(random_turns)


def test_long_and_hot_conversations(spark, monkeypatch):
    """One conversation of most turns, over several ranges and chunks, and many copies of another."""
    monkeypatch.setattr(p, "CHUNK_BITS", 5)
    turns = [(5, t, "user", str(t)) for t in range(400)] + [(c, t, "user", f"same {t}") for c in range(100, 180) for t in range(3)]
    assert got(spark, turns, base=64, bucket=5) == brute(turns)


def test_edges(spark):
    turns = [
        (1, None, None, None), (1, None, None, None), (1, 3, "user", "b"), (1, 3, "user", "a"), (2, 0, "", ""), (None, 0, "user", "lost"), (2, 0, "", ""),
        (3, 1, "user", "x" * 100_000), (8, 1, "user", "x" * 100_000), (4, 7, "a\nb", "c"), (9, 7, "a", "b\nc"),
    ]
    assert got(spark, turns) == brute(turns)
    assert got(spark, [(None, 1, "user", "x")]) == []  # no conversation at all


def test_ends_of_many_conversations(spark, monkeypatch):
    """Ids of one node in several pieces and partitions are one string, in numerical order."""
    turns = [(c, 0, "user", "one") for c in range(1, 10_001)]
    whole = got(spark, turns)
    shared = [c for c in range(1, 10_001) if zlib.crc32(str(c).encode()) % 9 == 0 or c - c % 5 > 0]
    alone = [c for c in range(1, 10_001) if c not in set(shared)]
    assert whole == sorted([(1, 0, None, 10_000, 1 if shared else 0, 1, (len(shared) - 1) * 3, hashlib.sha256(",".join(map(str, alone)).encode()).hexdigest()),
                            (min(shared), 1, 1, len(shared), 0, 1, (len(shared) - 1) * 3, hashlib.sha256(",".join(map(str, shared)).encode()).hexdigest())], key=str)


def test_ranking_of_a_list(spark):
    n, r = 3000, random.Random(1)
    order = list(range(0, 5 * n, 5))
    r.shuffle(order)
    links = [(x, order[i - 1] if i else None, order[i + 1] if i + 1 < n else None, 1, x) for i, x in enumerate(order)]
    r.shuffle(links)
    df = spark.createDataFrame(links, "id long, prev long, next long, one long, w long")
    total, want = 0, {}
    for i, x in enumerate(order):
        total += x
        want[x] = (i + 1, total)
    for base in (200, 5000):
        assert {r["id"]: (r["one"], r["w"]) for r in ranked(df, ("one", "w"), Scratch(spark), base).collect()} == want
    loop = df.withColumn("next", F.coalesce("next", F.lit(order[0])))
    with pytest.raises(Exception, match="not one list"):
        ranked(loop.withColumn("prev", F.coalesce("prev", F.lit(order[-1]))), ("one",), Scratch(spark), 5000).collect()
