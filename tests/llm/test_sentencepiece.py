import random

import pytest

from evalspark.llm.queries import TOKENIZERS
from evalspark.llm.sentencepiece import LONG, Trie, Vocabulary, encoded, vocabulary

MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def v():
    return vocabulary(MODEL)


def best_score(v, text):
    """Highest sum of scores over all ways to cut the text, by dynamic programming over all pieces."""
    keys = {p: s for i, (p, s) in enumerate(zip(v.pieces, v.scores)) if p and i not in set(v.bytes_at.tolist())}
    raw = b" " + text.encode()
    n, best = len(raw), [0.0] + [float("-inf")] * len(raw)
    for i in range(n):
        if (raw[i] & 0xC0) == 0x80:
            continue
        char = next(k for k in range(1, 5) if i + k == n or (raw[i + k] & 0xC0) != 0x80)
        if raw[i : i + char] not in keys:
            best[i + char] = max(best[i + char], best[i] + v.unknown)
        for k in range(1, min(n - i, 48) + 1):
            if raw[i : i + k] in keys:
                best[i + k] = max(best[i + k], best[i] + keys[raw[i : i + k]])
    return best[n]


def score(v, ids):
    """Score of ids; a run of byte pieces that make up one character costs one unknown character."""
    total, special, k = 0.0, set(v.bytes_at.tolist()), 0
    while k < len(ids):
        if ids[k] in special:
            lead = v.pieces[ids[k]][0]
            total += v.unknown
            k += 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        else:
            total += v.scores[ids[k]]
            k += 1
    return total


def test_best_cut_and_round_trip(v):
    rng = random.Random(1)
    texts = ["", " ", "  a  b ", "▁ and ▁▁", "naïve café\n\tx", "日本語のテキスト", "😀😀 ok", "a" * (LONG + 50), "Hello world, this is 1234!"]
    texts += ["".join(rng.choice("abc  ▁é\n😀thing ") for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    ids, at = v.encode([t.encode() for t in texts])
    flat = ids.tolist()
    for t, a, b in zip(texts, at[:-1].tolist(), at[1:].tolist()):
        assert v.decode(flat[a:b]).decode() == t
        if t:
            assert abs(score(v, flat[a:b]) - best_score(v, t)) < 1e-6, t
    for t in texts:  # the one-chunk walk gives what the walk in step gives
        for c in (" " + t).encode().split(b"\n")[:1]:
            if c:
                assert v._single(c).tolist() == v._lockstep([c], __import__("numpy").array([len(c)]))[0].tolist()


def test_same_as_a_unigram_library(v, documents):
    tokenizers = pytest.importorskip("tokenizers")
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    vocab = [(m.id_to_piece(i), float(v.scores[i]) if i > 2 and not m.is_byte(i) else -1e12) for i in range(m.vocab_size())]
    other = tokenizers.Tokenizer(tokenizers.models.Unigram(vocab, unk_id=0, byte_fallback=True))
    for r in documents.select("text").collect()[:40]:
        ids, theirs = v.encode([r["text"].encode()])[0].tolist(), other.encode("▁" + r["text"].replace(" ", "▁")).ids
        # equally good ways differ in the order of their pieces, as a|aa and aa|a
        assert abs(score(v, ids) - score(v, theirs)) < 1e-6 and sorted(ids) == sorted(theirs)


def test_scores_are_log_probabilities_that_follow_the_ranks(v, documents):
    import numpy as np
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    use = [i for i in range(m.vocab_size()) if i > 2 and not m.is_byte(i)]
    assert abs(np.exp(v.scores[use]).sum() - 1) < 1e-9
    assert (np.diff(v.scores[use][np.argsort([-m.get_score(i) for i in use], kind="stable")]) < 0).all()
    texts = [r["text"] for r in documents.select("text").where("text is not null").collect()]
    ours, theirs = len(v.encode([t.encode() for t in texts])[0]), sum(map(len, m.encode(texts)))
    assert theirs <= ours < 1.05 * theirs  # nearly as few pieces as the merges make
    assert [m.id_to_piece(int(i)) for i in v.encode([b"Device configuration is important"])[0]] == ["▁Device", "▁configuration", "▁is", "▁important"]


def test_trie_walks_to_every_key():
    keys = {b"a": 1, b"ab": 2, b"abc": 3, b"b": 4, bytes([255, 0]): 5, b"zz": 6}
    t = Trie.build(keys)
    for key, value in keys.items():
        node = 0
        for c in key:
            assert t.check[t.base[node] + c] == node
            node = t.base[node] + c
        assert t.value[node] == value


def test_marker_inside_a_piece_is_refused():
    with pytest.raises(ValueError):
        Vocabulary.of([("a▁b", -1.0)], [])


def test_table(table, documents):
    rows = {r["doc_id"]: r for r in encoded(table([None, "", "hi", "x" * 200_000, "hi"]), MODEL).collect()}
    assert rows[0]["ids"] is None and rows[0]["n_tokens"] == 0 and rows[1]["ids"] == [] and rows[2]["ids"] == rows[4]["ids"]
    assert all(r["exact"] for r in rows.values())
    assert encoded(table([]), MODEL).count() == 0
    assert encoded(documents, MODEL).where("not exact").count() == 0


def test_long_chunks_are_cut_where_no_piece_crosses(v):
    import time

    import numpy as np

    r = np.random.default_rng(5)
    for text in ("".join(chr(0x4E00 + k) for k in r.integers(0, 3000, 400)), "https://example.org/" + "".join(r.choice(list("abcdefgh-/"), 500)), "x" * 300, "ab" * 200 + "é\U0001f600" * 40):
        chunk = text.encode()
        parts = v.cut(chunk)
        assert b"".join(parts) == chunk
        together = [i for p in parts for i in v._single(p).tolist()]
        whole = v._single(chunk).tolist()
        assert abs(score(v, together) - score(v, whole)) < 1e-6 and len(together) == len(whole)
        assert v.decode(v.encode([chunk])[0].tolist()) == chunk
    text = "".join(chr(0x4E00 + k) for k in r.integers(0, 3000, 300_000)).encode()
    assert len(v.cut(text)) > 100_000
    began = time.time()
    v.encode([text])
    assert time.time() - began < 5


def test_ids_of_any_kind(table):
    rows = encoded(table([(None, "one"), (3, "one"), (3, "two"), (None, None)]), MODEL).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in rows) == [("3", "one"), ("3", "two"), ("None", "None"), ("None", "one")]
