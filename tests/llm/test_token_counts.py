import random

import numpy as np

from evalspark.llm.common import Scratch
from evalspark.llm.queries import SPLIT, TOKENIZERS
from evalspark.llm.redaction import PLACEHOLDER, first_line, redactions
from evalspark.llm.token_counts import Counter, PieceTree, built, counted, edited

RANKS = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"


def test_every_edit_gives_the_count_of_the_whole_text(documents):
    c, rng = Counter(RANKS, SPLIT), random.Random(3)
    texts = [r["text"] for r in documents.select("text").collect()][:60] + ["", "a", "  \n x", "don't  we'll", " \t\n " * 300]
    for t in texts:
        tree, text = PieceTree.of(t, c), t
        for _ in range(12):
            n = len(text)
            at, remove = rng.choice([0, n, rng.randint(0, n)]), rng.choice([0, 1, 3, rng.randint(0, n) // 4])
            insert = rng.choice(["", " ", "\n\n", "'s", "x", " the cat", t[: rng.randint(0, 900)], "é€ 12", "y" * 2000])
            tree.edit(at, remove, insert)
            text = text[:at] + insert + text[min(at + remove, n) :]
            assert tree.text == text and [len(x) for x in c.split.findall(text)] == np.concatenate(tree.lens).tolist()
            assert tree.count == len(c.encode(text)) and tree.chars[1] == len(text) and [len(b) for b in tree.blocks] == [x.sum() for x in tree.lens]


def test_only_the_touched_region_is_encoded():
    c = Counter(RANKS, SPLIT)
    tree = PieceTree.of("some words in a row " * 500, c)
    tree.edit(5000, 3, "new")
    assert tree.encoded < 10


def after(text):
    for policy in (redactions, first_line):
        for e in policy(text):
            text = text[: e["at"]] + e["insert"] + text[e["at"] + e["remove"] :]
    return text


def test_stored_trees_edited_twice(table, documents, spark):
    """Edits of the stored table, and edits of that, count as the whole text that they leave."""
    c, scratch = Counter(RANKS, SPLIT), Scratch(spark)
    texts = [None, "", "no edits here", "title\nmail a@b.co and 0123456789abcdef01 end", "x " * 50_000, (3, "again\nunder one id"), (None, "a line\nand no id")]
    for docs in (table(texts), documents):
        trees = scratch.save(built(docs, RANKS, SPLIT), "trees")
        once = scratch.save(edited(trees, RANKS, SPLIT, redactions), "once")
        got = counted(edited(once, RANKS, SPLIT, first_line)).collect()
        both = counted(edited(trees, RANKS, SPLIT, redactions, first_line)).collect()
        assert sorted(both, key=str) == sorted(got, key=str)
        want = sorted(((r["doc_id"], len(c.encode(r["text"] or "")), len(c.encode(after(r["text"] or ""))), len(after(r["text"] or ""))) for r in docs.collect()), key=str)
        assert sorted(((r["doc_id"], r["tokens_before"], r["tokens_after"], r["chars_after"]) for r in got), key=str) == want
    rows = {r["doc_id"]: r for r in counted(edited(edited(built(table(texts[:4]), RANKS, SPLIT), RANKS, SPLIT, redactions), RANKS, SPLIT, first_line)).collect()}
    assert rows[3]["n_edits"] == 3 and rows[3]["tokens_after"] == len(c.encode(f"mail {PLACEHOLDER} and {PLACEHOLDER} end"))
    assert edited(built(table([]), RANKS, SPLIT), RANKS, SPLIT, first_line).count() == 0


def test_edits_from_a_column(table, spark):
    c = Counter(RANKS, SPLIT)
    trees = built(table(["one two three", "four", None]), RANKS, SPLIT)
    edits = "case when doc_id = 0 then array(named_struct('at', 4L, 'remove', 3L, 'insert', 'twenty'), named_struct('at', 0L, 'remove', 0L, 'insert', cast(null as string))) when doc_id = 2 then array(named_struct('at', 9L, 'remove', 9L, 'insert', 'new')) end AS edits"
    got = {r["doc_id"]: (r["n_edits"], r["tokens_after"]) for r in counted(edited(trees.selectExpr("*", edits), RANKS, SPLIT)).collect()}
    assert got == {0: (2, len(c.encode("one twenty three"))), 1: (0, 1), 2: (1, len(c.encode("new")))}
