"""The registered queries op1 to op13, and the SQL of those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm import quality, toxicity
from evalspark.llm.chat import formatted
from evalspark.llm.common import Scratch, batch_bytes, held_out, read
from evalspark.llm.hard_negatives import mined
from evalspark.llm.language_id import predicted, train
from evalspark.llm.licenses import PHRASES, TEMPLATES, as_pattern, mandatory, parsed, scanned
from evalspark.llm.mixing import mixed
from evalspark.llm.near_dedup import NearDedup, near_duplicates
from evalspark.llm.neighbours import nearest
from evalspark.llm.prefix_trie import prefix_trie
from evalspark.llm.redaction import first_line, redactions
from evalspark.llm.sentencepiece import encoded
from evalspark.llm.substring_dedup import substring_dedup
from evalspark.llm.token_counts import built, counted, edited

#: Folder of the public tokenizers' files on every executor.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")

#: Pattern of the public byte-level vocabularies: what splits a text before merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), NearDedup(shingle_words=2))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = predicted(docs.select("doc_id", "text"), train(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "cross_entropy", "rejected")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(read(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model").select("doc_id", "n_tokens", "ids", "exact")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, F.coalesce(F.pmod("vec_id", F.lit(50)) == 0, F.lit(False)))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees are stored; personal data are taken out of the stored trees, then first lines out of those."""
    ranks = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
    scratch = Scratch(spark)
    with batch_bytes(spark, 8 << 20):
        # a tree has about three times its text's bytes: small row groups keep few of them in memory at a time
        trees = scratch.save(built(read(spark, sf_dir, "documents"), ranks, SPLIT), "trees", compression="zstd", **{"parquet.block.size": str(8 << 20)})
        return scratch.save(counted(edited(trees, ranks, SPLIT, redactions, first_line)), "counts")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read(spark, sf_dir, "labels").where(~held_out()))
    return toxicity.scored(docs, model).withColumn("held_out", held_out()).select("doc_id", "held_out", "score", "predicted")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judged(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return formatted(turns.union(more))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read(spark, sf_dir, "conversations"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.pmod("vec_id", F.lit(7)) == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return mined(rows.withColumn("label", moved), F.pmod("vec_id", F.lit(50)) == 0)


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup, op2_language_id, op3_sentencepiece, op4_mix_sources, op5_nearest_neighbours, op6_token_counts, op7_toxicity, op8_substring_dedup, op9_quality_rules, op10_chat_format,
        op11_prefix_trie, op12_hard_negatives, op13_license_scan,
    )
}

WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"



def license_sql() -> str:
    """Phrases by comparing words, templates as regular expressions over the words."""
    phrases = {p: p.split() for p in PHRASES}
    at = {p: " AND ".join(f"words[i + {k}] = '{w}'" for k, w in enumerate(ws)) for p, ws in phrases.items()}
    hits = ", ".join(f"list_filter(range(1, len(words) + 1), lambda i: {at[p]}) AS hits{n}" for n, p in enumerate(phrases))
    names = {label for label, _ in TEMPLATES} | set(PHRASES.values())
    has = {n: f"regexp_matches(line, ' {as_pattern(parsed(t))}')" for n, (_, t) in enumerate(TEMPLATES)}
    based = {label: " OR ".join(f"len(hits{n}) > 0" for n, p in enumerate(phrases) if PHRASES[p] == label) for label in PHRASES.values()}
    labelled = {name: " OR ".join([f"t{n}" for n, (label, _) in enumerate(TEMPLATES) if label == name] + ([based[name]] if name in based else [])) for name in names}
    listed = lambda by: "concat_ws(',', " + ", ".join(f"CASE WHEN {by[x]} THEN '{x}' END" for x in sorted(by)) + ")"
    most = ", ".join([f"CASE WHEN t{n} THEN {mandatory(parsed(t))} ELSE 0 END" for n, (_, t) in enumerate(TEMPLATES)] + [f"CASE WHEN len(hits{n}) > 0 THEN {len(ws)} ELSE 0 END" for n, ws in enumerate(phrases.values())])
    every = "list_concat(" * (len(phrases) - 1) + "hits0" + "".join(f", hits{n})" for n in range(1, len(phrases)))
    return rf"""
WITH split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
found AS (SELECT doc_id, words, ' ' || array_to_string(words, ' ') || ' ' AS line, {hits} FROM split),
judged AS (SELECT *, {every} AS every, {", ".join(f"{x} AS t{n}" for n, x in has.items())} FROM found),
sized AS (SELECT *, greatest({most}) AS most FROM judged)
SELECT doc_id, len(words)::BIGINT AS n_words, len(every)::BIGINT AS n_base, (list_min(every) - 1)::BIGINT AS first_word, (list_max(every) - 1)::BIGINT AS last_word,
  {listed(based)} AS base_labels, {listed(labelled)} AS labels, CASE WHEN most > 0 THEN 1 - 1 / (1 + most)::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM sized"""


ORACLES: dict[str, str] = {
    "op4_mix_sources": f"""
WITH sizes AS (
  SELECT doc_id, source, len({WORDS_SQL})::BIGINT AS size, md5('mix|' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))) AS key FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS pos FROM sizes GROUP BY source),
weighed AS (SELECT *, CASE pos % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 2 AS cap FROM per),
filled AS (SELECT *,
    coalesce(sum(cap) OVER w, 0) AS full_words, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS open_weight,
    sum(source_size) OVER () * 150 / 100.0::DOUBLE AS total
  FROM weighed WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, (total - full_words) / open_weight::DOUBLE AS level FROM filled),
chosen AS (SELECT *, max(CASE WHEN level <= cap / weight THEN level END) OVER () AS common FROM levels),
goals AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(common * weight, cap::DOUBLE)) AS target FROM chosen),
placed AS (SELECT s.*, g.source_size, g.target, floor(g.target)::BIGINT AS budget,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM sizes s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size + greatest(0, least(size,
    budget - CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * source_size - ahead)))::BIGINT AS taken
FROM placed""",
    "op8_substring_dedup": f"""
WITH docs AS (SELECT doc_id, {WORDS_SQL} AS words FROM documents),
windows AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS first_word FROM docs WHERE len(words) >= 50),
hashed AS (SELECT doc_id, first_word, md5(array_to_string(list_slice(words, first_word, first_word + 49), ' ')) AS digest FROM windows),
owned AS (SELECT doc_id, first_word, min(doc_id) OVER (PARTITION BY digest) AS owner FROM hashed),
gone AS (SELECT DISTINCT doc_id, unnest(range(first_word, first_word + 50)) AS pos FROM owned WHERE owner < doc_id),
cuts AS (SELECT doc_id, list(pos) AS positions FROM gone GROUP BY doc_id),
judged AS (SELECT d.doc_id, d.words, coalesce(c.positions, []) AS positions FROM docs d LEFT JOIN cuts c USING (doc_id)),
spread AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM docs),
kept AS (SELECT s.doc_id, string_agg(word, ' ' ORDER BY s.pos) AS text FROM spread s ANTI JOIN gone g ON s.doc_id = g.doc_id AND s.pos = g.pos GROUP BY s.doc_id)
SELECT j.doc_id, len(j.words)::BIGINT AS n_words, len(j.positions)::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM judged j LEFT JOIN kept k USING (doc_id)""",
    "op10_chat_format": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (SELECT *, 4 + 2 + 8 + length(regexp_replace(text, '([\\#<])', 'xx', 'g')) + length(regexp_replace(role, '([\\#<:])', 'xx', 'g')) AS size FROM turns)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(size)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id""",
    "op11_prefix_trie": """
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS depth
  FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT conv_id, count(*) AS n, list_reduce(range(8 * length(conv_id::VARCHAR)), lambda s, k: CASE
    WHEN (CASE WHEN k % 8 = 0 THEN xor(s, ascii(substr(conv_id::VARCHAR, (k // 8 + 1)::INT, 1))) ELSE s END) & 1 = 1
    THEN xor((CASE WHEN k % 8 = 0 THEN xor(s, ascii(substr(conv_id::VARCHAR, (k // 8 + 1)::INT, 1))) ELSE s END) >> 1, 3988292384)
    ELSE (CASE WHEN k % 8 = 0 THEN xor(s, ascii(substr(conv_id::VARCHAR, (k // 8 + 1)::INT, 1))) ELSE s END) >> 1 END, 4294967295) AS crc
  FROM own GROUP BY conv_id),
shared AS (SELECT a.conv_id, xor(a.crc, 4294967295) % 9 AS h, a.conv_id - a.conv_id % 5 AS base, least(xor(a.crc, 4294967295) % 9, coalesce(b.n, 0)) AS given, a.n
  FROM sizes a LEFT JOIN sizes b ON b.conv_id = a.conv_id - a.conv_id % 5),
turns AS (
  SELECT s.conv_id, o.depth AS pos, o.role, o.text FROM shared s JOIN own o ON o.conv_id = s.base AND o.depth < s.h
  UNION ALL SELECT s.conv_id, o.depth - s.h + s.given, o.role, o.text FROM shared s JOIN own o ON o.conv_id = s.conv_id AND o.depth >= s.h),
path AS (
  SELECT conv_id, pos + 1 AS depth, strlen(text) AS bytes, string_agg(md5(role || chr(0) || text), '' ORDER BY pos) OVER (PARTITION BY conv_id ORDER BY pos) AS node FROM turns
  UNION ALL SELECT conv_id, 0, 0, '' FROM shared),
nodes AS (SELECT node, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saved FROM path GROUP BY node),
up AS (SELECT n.*, p.conv_id AS parent_conv_id, CASE WHEN n.depth > 0 THEN left(n.node, -32) END AS parent FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.node = left(n.node, -32)),
kids AS (SELECT parent, count(*) AS n_children FROM up WHERE parent IS NOT NULL GROUP BY parent),
below AS (
  SELECT p.node, count(*) FILTER (k.n_children IS NULL) AS n_leaves, sum(u.saved) AS saved_tokens
  FROM up u LEFT JOIN kids k ON k.parent = u.node JOIN path p ON p.conv_id = u.conv_id AND p.depth <= u.depth GROUP BY p.node),
ends AS (SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM path p
  WHERE depth = (SELECT greatest(s.n - s.h, 0) + s.given FROM shared s WHERE s.conv_id = p.conv_id) GROUP BY node)
SELECT u.conv_id, u.depth::BIGINT AS depth, u.parent_conv_id, u.n_convs::BIGINT AS n_convs, coalesce(k.n_children, 0)::BIGINT AS n_children, b.n_leaves::BIGINT AS n_leaves,
  b.saved_tokens::BIGINT AS saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM up u LEFT JOIN kids k ON k.parent = u.node JOIN below b ON b.node = u.node LEFT JOIN ends e ON e.node = u.node""",
    "op12_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
ranked AS (SELECT anchor_id, positive_id, positive_score, n.vec_id AS negative_id, n.score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.vec_id) AS rank
  FROM positives p JOIN scored n USING (anchor_id) WHERE n.label <> n.anchor_label AND 50 * positive_score <= 100 * n.score AND 100 * n.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3""",
    "op13_license_scan": license_sql(),
}
