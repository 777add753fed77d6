"""Inputs derived from the driver's tables by plain SQL that Spark and DuckDB both run (see FIXTURES.md)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "benchmark", "labels", "conversations")

MODEL = "concat('gen_', CAST(l_suppkey % 8 AS STRING), '_ind_', CAST(l_linenumber % 4 AS STRING))"

VIEWS = {
    "samples": f"""
SELECT l_returnflag AS benchmark, l_linestatus AS filter, {MODEL} AS model_name,
  CAST((l_suppkey % 8) * 4 + (l_linenumber % 4) AS BIGINT) AS ord, l_suppkey % 8 AS gen, l_partkey AS sample_id,
  CAST(max(l_quantity) AS DOUBLE) / 50 AS score, max(l_quantity) >= 40 AS correct
FROM lineitem GROUP BY l_returnflag, l_linestatus, l_suppkey % 8, l_linenumber % 4, l_partkey""",
    "skills": f"""
SELECT l_suppkey % 8 AS gen, CAST((l_suppkey % 8) * 4 + (l_linenumber % 4) AS BIGINT) AS ord, {MODEL} AS model_path,
  l_partkey AS task_number, CAST(max(l_quantity) AS DOUBLE) / 50 AS score
FROM lineitem GROUP BY l_suppkey % 8, l_linenumber % 4, l_partkey""",
    "active_pool": """
SELECT g.r_regionkey AS gen, p.p_partkey AS task_number FROM region g
JOIN part p ON g.r_regionkey >= p.p_size % 5 AND g.r_regionkey <= p.p_size % 5 + p.p_size % 3""",
    "tasks": """
SELECT p_partkey AS task_number, concat('task_', CAST(p_partkey AS STRING), '_', lower(replace(p_name, ' ', '_'))) AS task_id,
  CASE WHEN p_partkey > 4 THEN CAST(floor(p_partkey / 2) AS BIGINT) END AS parent_number,
  CASE p_size % 4 WHEN 0 THEN 'initial' WHEN 1 THEN 'adaptation_easier' WHEN 2 THEN 'adaptation_harder' ELSE 'adaptation_novel' END AS generation_type,
  CAST(p_partkey % 17 AS DOUBLE) / 16 AS original_pass_rate
FROM part""",
    "model_edges": """
SELECT DISTINCT concat('gen_', CAST(gen AS STRING), '_ind_', CAST(ord % 4 AS STRING)) AS child,
  concat('gen_', CAST(gen - 1 AS STRING), '_ind_', CAST((ord * k + 1) % 4 AS STRING)) AS parent
FROM skills CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 AS k) ks WHERE gen > 0""",
    "token_logprobs": """
SELECT user_id % 8 AS ord, event_id % 100 AS sample_id, event_id AS pos, -abs(CAST(value AS DOUBLE)) / 100 - CAST(0.01 AS DOUBLE) AS logprob FROM events""",
    "questions": "SELECT doc_id AS idx, lang AS subgroup, source AS benchmark, text AS question FROM documents",
    "invalid_questions": "SELECT doc_id AS idx FROM labels WHERE toxic = 1",
    "assistant_texts": "SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'",
    "verdicts": """
SELECT sample_id, CASE WHEN sample_id % 7 = 0 THEN 'no decision'
  ELSE concat('because. DECISION: ', CAST(sample_id % 5 + 1 AS STRING)) END AS response
FROM (SELECT DISTINCT sample_id FROM samples) s""",
    # model, fitness and its place in the archive
    "archive": """
SELECT gen, ord, model_path, avg(score) AS fitness, count(*) AS n_skills, ord % 5 = 3 AS is_gibberish, CAST(ord % 4 AS DOUBLE) / 4 AS validation_quality
FROM skills GROUP BY gen, ord, model_path""",
    # whole-number scores, so that sums agree in any order
    "points": """
SELECT gen, ord, model_path, task_number, CAST(round(score * 50) AS BIGINT) AS points, score >= 0.8 AS solved FROM skills""",
}
USES = {"model_edges": ("skills",), "verdicts": ("samples",), "archive": ("skills",), "points": ("skills",)}

#: Rows of a table that come to one task where it is dealt out by a key.
DEALT_ROWS = 250_000


class Views:
    """The driver's tables and the derived inputs of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in VIEWS:
            raise AttributeError(name)
        return self._view(name)

    def _view(self, name: str, **instead: DataFrame) -> DataFrame:
        used = {t: instead[t] if t in instead else getattr(self, t) for t in (*TABLES, *USES.get(name, ())) if re.search(rf"\b(FROM|JOIN)\s+{t}\b", VIEWS[name])}
        text = re.sub(r"\b(FROM|JOIN)(\s+)(\w+)\b", lambda m: f"{m[1]}{m[2]}{{{m[3]}}}" if m[3] in used else m[0], VIEWS[name])
        return self.spark.sql(text, **used)

    @property
    def samples_by_sample(self) -> DataFrame:
        """``samples`` from lines dealt out by sample first, to tasks in proportion to the lines. All later groupings by
        sample lie in these tasks, without a shuffle more, and none holds more than its share however large the table."""
        lines = self.lineitem
        tasks = max(1, -(-lines.count() // DEALT_ROWS))
        return self._view("samples", lineitem=lines.repartition(tasks, "l_partkey"))


def ctes(*names: str) -> str:
    """``WITH`` list of the views and what they use, for DuckDB."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in USES.get(name, ()):
            add(other)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    return ", ".join(f"{n} AS ({VIEWS[n]})" for n in order)
