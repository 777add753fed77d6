import hashlib

import pytest

from evalspark.llm.chat import formatted, prefix_tree, unescape
from evalspark.llm.common import Scratch

SCHEMA = "conv_id long, turn long, role string, text string"


def want(rows):
    per = {}
    for c, t, r, x in rows:
        per.setdefault(c, []).append((t if t is not None else -1, r or "", x or ""))
    out = {}
    for c, turns in per.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def found(df):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in formatted(df).collect()}


ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "more"), (1, 3, "assistant", "a"),
    (2, 0, "user", "hi"), (2, 1, "assistant", "yes"), (2, 2, "user", "else"), (2, 3, "assistant", "\\\\#<"),
    (3, 0, "user", "hi"), (3, 1, "assistant", "no"),
    (4, 0, "user", "hi"), (4, 1, "assistant", "yes"),
    (5, 0, None, None), (5, 1, "assistant", None), (5, 2, "we: ird#\\", "</turn>\n### assistant: x</turn>\n"),
    (-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok"),
    (8, 0, "assistant", "é😀\n\n"), (8, 1, "assistant", "long " * 40_000),
    (9, 0, "user", "tie"), (9, 0, "user", "tie"), (9, None, "assistant", "first"),
]


def test_round_trip(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "1 AS node", "'x' AS path", "2 AS begin")
    assert found(df) == want(ROWS)
    assert formatted(df.limit(0)).count() == 0


def test_whole_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert found(df) == want([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in df.collect()])


def test_shared_turns_stand_once_in_depth_first_order(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    nodes, ways = prefix_tree(df, Scratch(spark))
    rows = sorted(nodes.collect(), key=lambda r: r["begin"])
    assert sum(r["text"] == "### user: hi</turn>\n" for r in rows) == 1
    at, stack = 0, []
    for r in rows:
        assert r["begin"] == at  # no gap, nothing twice
        at += r["size"]
        stack = stack[: r["depth"]]
        seen = []
        for s in stack:  # touching intervals are one
            begin = seen.pop()[0] if seen and seen[-1][1] == s["begin"] else s["begin"]
            seen.append((begin, s["begin"] + s["size"]))
        assert [(a["begin"], a["end"]) for a in r["attention"]] == seen
        assert r["position"] == sum(s["size"] for s in stack) and r["parent"] == (stack[-1]["node"] if stack else None)
        stack.append(r)
    assert ways.count() == len(ROWS) and ways.select("conv_id").distinct().count() == len({r[0] for r in ROWS})
    whole = "".join(r["text"] for r in rows)
    for r in rows:
        if r["loss_from"] is not None:
            assert unescape(whole[r["begin"] + r["loss_from"] : r["begin"] + r["loss_to"]]) in {x or "" for _, _, role, x in ROWS if role == "assistant"}


def test_broken_output_is_an_error(spark):
    from pyspark.sql import functions as F

    from evalspark.llm.chat import read_back

    nodes, ways = prefix_tree(spark.createDataFrame(ROWS, SCHEMA), Scratch(spark))
    with pytest.raises(Exception, match="broken"):
        read_back(nodes.withColumn("position", F.col("position") + F.when(F.col("depth") == 1, 1).otherwise(0)), ways).collect()


def test_thousands_of_turns_and_a_common_beginning(spark):
    """The tree of one long conversation stays as small as its text, and a common beginning is no single group."""
    long = [(1, i, "user" if i % 2 == 0 else "assistant", f"turn {i}") for i in range(3000)]
    many = [(10 + c, i, r, x) for c in range(300) for i, (r, x) in enumerate([("system", "be kind"), ("user", "what now?"), ("assistant", f"answer {c // 2}"), ("user", "thanks")])]
    none = [(None, 0, "user", "no id"), (None, 1, "assistant", "none at all")]
    rows = long + many + none
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(df) == want(rows)
    nodes = prefix_tree(df, Scratch(spark))[0].collect()
    assert len(nodes) == 3000 + 2 + 2 * 150 + 2 and sum(len(r["attention"]) for r in nodes) < 2 * len(nodes)
    assert sum(r["conversations"] for r in nodes) == len(rows)
