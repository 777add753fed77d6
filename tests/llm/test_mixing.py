import pytest

from evalspark.llm.mixing import Mixing, mixed


def water(sizes, weights, total, epochs=2):
    """Targets by resharing what is above the caps until nothing is."""
    caps, full = [epochs * s for s in sizes], set()
    while True:
        rest = total - sum(caps[i] for i in full)
        w = sum(weights[i] for i in range(len(sizes)) if i not in full)
        share = [caps[i] if i in full else rest * weights[i] / w for i in range(len(sizes))]
        over = {i for i in range(len(sizes)) if i not in full and share[i] > caps[i]}
        if not over:
            return share
        full |= over


@pytest.mark.parametrize("digits", [1, 3])
def test_targets_and_budgets(documents, digits):
    got = mixed(documents, Mixing(bucket_digits=digits)).toPandas()
    per = got.groupby("source", dropna=False).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum")).reset_index().sort_values("source", na_position="last")
    want = water(per["size"].tolist(), [(5, 2, 1)[i % 3] for i in range(len(per))], 1.5 * per["size"].sum())
    assert all(abs(a - b) < 1e-6 * max(1, b) for a, b in zip(per["target"], want))
    assert all(t == int(g) for t, g in zip(per["taken"], per["target"] + 1e-9))
    assert ((got["taken"] <= 2 * got["size"]) & (got["taken"] >= 0)).all()
    again = mixed(documents.repartition(5), Mixing(bucket_digits=digits)).toPandas()
    assert dict(zip(got["doc_id"], got["taken"])) == dict(zip(again["doc_id"], again["taken"]))


def test_edges(table):
    rows = mixed(table([None, "", "a b", "a b c", "x " * 1000, " ", "same", "same"])).collect()
    size = {r["doc_id"]: r["size"] for r in rows}
    assert size == {0: 0, 1: 0, 2: 2, 3: 3, 4: 1000, 5: 1, 6: 1, 7: 1}
    assert {r["source"] for r in rows} == {"s0", "s1", None}
    assert mixed(table([])).count() == 0
    assert [r["taken"] for r in mixed(table([None, ""])).collect()] == [0, 0]


def test_ids_of_any_kind(spark):
    """Rows without an id are dealt out by their texts, and repeated ids are rows like others: budgets hold, reruns agree."""
    rows = [(None, f"word {i} " * (i % 7)) for i in range(300)] + [(i % 10, f"text {i}") for i in range(100)]
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string").selectExpr("*", "1 AS bucket", "2 AS key")
    got, again = (sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in mixed(x).collect()) for x in (df, df.repartition(7)))
    assert got == again and len(got) == 400
    total = sum(s for _, s, _ in got)
    assert sum(t for *_, t in got) == int(1.5 * total) and all(t <= 2 * s for _, s, t in got)
