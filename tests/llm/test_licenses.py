import random
import re

import pytest

from evalspark.llm import licenses
from evalspark.llm.licenses import TEMPLATES, Automaton, as_pattern, mandatory, parsed, scanned
from evalspark.llm.queries import ORACLES, op13_license_scan
from tests.compare import connection, rows

FULL = {label: t for label, t in TEMPLATES}


def brute(words, templates):
    line = " " + "".join(f"{w} " for w in words)
    return {i for i, (_, parts) in enumerate(templates) if re.search(" " + as_pattern(parts), line)}


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    assert rows(op13_license_scan(spark, sf).toPandas()) == rows(connection(sf).sql(ORACLES["op13_license_scan"]).df())


def test_automaton_against_patterns():
    """Random templates with nested optional and replaceable regions over three words, against regular expressions."""
    r = random.Random(5)

    def part(depth):
        x = r.random()
        if x < 0.2 and depth:
            return "[[ " + " ".join(part(depth - 1) for _ in range(r.randint(1, 3))) + " ]]"
        return f"<<{r.randint(0, 3)}>>" if x < 0.35 else r.choice("abc")

    for _ in range(60):
        templates = [(str(i), parsed(" ".join(part(2) for _ in range(r.randint(1, 6))) + " a")) for i in range(3)]
        automaton = Automaton(templates)
        for _ in range(20):
            words = r.choices("abcd", k=r.randint(0, 14))
            assert automaton.scan([w.encode() for w in words]) == brute(words, templates), (templates, words)


def test_states_are_forgotten_without_effect(monkeypatch):
    monkeypatch.setattr(licenses, "STATES_MAX", 3)
    templates = [("x", parsed("a <<2>> b [[c]] d"))]
    automaton = Automaton(templates)
    for text in ("a x y b d", "a b c d", "a x y z b d", "a a b d", "b d"):
        assert automaton.scan([w.encode() for w in text.split()]) == brute(text.split(), templates)


def test_markup():
    assert parsed("a [[b <<3>> [[c]]]] d") == ["a", ["b", 3, ["c"]], "d"]
    assert mandatory(parsed("a [[b c]] <<4>> d")) == 2
    for bad in ("a [[b", "a ]] b"):
        with pytest.raises(ValueError):
            parsed(bad)
    with pytest.raises(ValueError):
        Automaton([("x", parsed("[[a]] <<2>>"))])


def test_whole_licenses(spark, table):
    plain = {label: re.sub(r"<<\d+>>", "the regents of x", re.sub(r"\[\[|\]\]", " ", t)) for label, t in FULL.items()}
    texts = [f"Start. {t.upper()}, end" for t in plain.values()]
    got = {r["doc_id"]: r for r in scanned(table(texts)).collect()}
    for i, label in enumerate(plain):
        assert label in got[i]["labels"].split(","), label
    whole = plain["mit"]
    changed = whole.replace("noninfringement", "infringement")
    kept = re.sub(r"<<\d+>>", "", re.sub(r"\[\[.*?\]\]", "", FULL["bsd-3-clause"]))
    long = FULL["bsd-3-clause"].replace("<<12>>", "w " * 13).replace("[[", "").replace("]]", "")
    labels = {r["doc_id"]: r["labels"] for r in scanned(table([whole, changed, kept, long])).collect()}
    assert labels[0] == "mit" and labels[1] == "" and "bsd-3-clause" in labels[2] and labels[3] == "bsd-2-clause"


def test_edges(spark, table):
    texts = [
        None, "", "?!", "gnu  General-public\nlicense", "cc by cc by", "xcc by", "The MIT License. the mit license", "ümit license", "Apache License " * 3,
        (None, "mit license"), (7, "mit license"), (7, "cc by"), "x " * 200_000 + "cc by",
    ]
    got = sorted(((r["doc_id"] is None, r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) for r in scanned(table(texts)).collect()), key=str)
    want = [
        (False, 0, 0, 0, None, None, "", ""), (False, 1, 0, 0, None, None, "", ""), (False, 2, 0, 0, None, None, "", ""), (False, 3, 4, 1, 0, 0, "gpl", "gpl"),
        (False, 4, 4, 2, 0, 2, "cc-by", "cc-by"), (False, 5, 2, 0, None, None, "", ""), (False, 6, 6, 2, 1, 4, "mit", "mit"), (False, 7, 2, 0, None, None, "", ""),
        (False, 8, 6, 3, 0, 4, "apache", "apache"), (True, None, 2, 1, 0, 0, "mit", "mit"), (False, 7, 2, 1, 0, 0, "mit", "mit"), (False, 7, 2, 1, 0, 0, "cc-by", "cc-by"),
        (False, 12, 200_002, 1, 200_000, 200_000, "cc-by", "cc-by"),
    ]
    assert got == sorted(want, key=str)
    assert scanned(table([])).count() == 0
