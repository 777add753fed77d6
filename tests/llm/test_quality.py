import re
from collections import Counter

from pyspark.sql import functions as F

from evalspark.llm.common import held_out
from evalspark.llm.quality import Quality, judged, train


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    twice = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(twice)


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_counts(table, documents):
    texts = [None, "", " ", "é€😀 #*|", "a\na\n\n a\na", "a b c d e " * 3, "x " * 4, "x " * 6, "one two\r\nthree\x0bfour", "w " * 60_000]
    for df in (table(texts), documents):
        want = {r["doc_id"]: brute(r["text"]) for r in df.select("doc_id", "text").collect()}
        for r in judged(df, None).collect():
            assert tuple(r[c] for c in NAMES) == want[r["doc_id"]]
            n, rep = r["n_words"], r["n_repeat_words"]
            assert r["base_failed"] == (n < 10 or 100 * rep > 20 * n) and r["kept"] == (not r["base_failed"])


def test_held_out(documents, spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = train(documents, labels.where(~held_out()))
    got = judged(documents, model).join(labels, "doc_id").where(held_out()).toPandas()
    assert ((got["quality_score"] >= 0.5) == (got["quality"] == 1)).mean() > 0.9
    assert got["quality_score"].between(0, 1).all()


def test_edges(table):
    rows = table(["good words in a row " * 3, "### $$$ ||| " * 9] * 12)
    labels = rows.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("quality"))
    model = train(rows, labels, Quality(steps=40))
    got = {r["doc_id"]: r["quality_score"] for r in judged(table(["good words in a row", "||| ### $$$", None, ""]), model).collect()}
    assert got[0] > got[1] and got[2] == got[3]
    assert train(rows, labels.where("quality = 1")) is None and train(table([]), labels) is None
    assert judged(table([]), model).count() == 0


def test_ids_of_any_kind(table):
    rows = judged(table([(None, "a b c"), (3, "a b c"), (3, "d"), (None, None)]), None).collect()
    assert sorted((str(r["doc_id"]), r["n_words"]) for r in rows) == [("3", 1), ("3", 3), ("None", 0), ("None", 3)]
