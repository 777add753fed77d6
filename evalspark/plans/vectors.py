"""Vector store, similarity and diversity queries."""

import pandas as pd
from pyspark.sql import functions as F

from evalspark.operators import clusters
from evalspark.operators import vectors as o
from evalspark.plans.registry import query


def store(v):
    meta = F.create_map(F.lit("benchmark"), "source", F.lit("type"), F.when(F.col("doc_id") % 2 == 0, "open").otherwise("multiple_choice"), F.lit("subgroup"), "lang")
    return v.documents.select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("sample_id"), F.col("text").alias("content"), meta.alias("metadata"), F.col("doc_id").alias("ord"))


def vector_rows(v):
    return v.embeddings.select(F.col("vec_id").alias("sample_id"), "embedding", F.col("label").cast("string").alias("benchmark"), F.concat(F.lit("text "), F.col("vec_id").cast("string")).alias("content"))


def asked(v):
    """The stated queries: the first vector of every label."""
    return v.embeddings.groupBy("label").agg(F.min("vec_id").alias("vec_id")).join(v.embeddings.select("vec_id", "embedding"), "vec_id").select(F.col("vec_id").alias("query_id"), "embedding")


HITS = "asked AS (SELECT min(vec_id) AS q FROM embeddings GROUP BY label), hits AS (SELECT q.q AS query_id, e.vec_id AS sample_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) AS similarity FROM asked q JOIN embeddings a ON a.vec_id = q.q CROSS JOIN embeddings e), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, sample_id) AS rank FROM hits WHERE similarity >= 0.0)"


@query("h01_embedded", "SELECT doc_id, 8 AS dim, length(text) AS first FROM documents")
def embedded(v):
    def embed(texts: pd.Series) -> list:
        return [[float(len(t))] + [0.0] * 7 for t in texts]

    return o.embedded(v.documents.select("doc_id", "text"), "text", embed, 8).select("doc_id", F.size("embedding").alias("dim"), F.col("embedding")[0].cast("bigint").alias("first"))


@query("h02_text_representation", "SELECT doc_id, concat('benchmark: ', source, chr(10), 'subgroup: ', lang, chr(10), 'type: ', CASE WHEN doc_id % 2 = 0 THEN 'open' ELSE 'multiple_choice' END) AS insert_text, concat('benchmark: ', source, chr(10), 'type: ', CASE WHEN doc_id % 2 = 0 THEN 'open' ELSE 'multiple_choice' END, chr(10), 'subgroup: ', lang, chr(10)) AS query_text FROM documents")
def representation(v):
    return store(v).select(F.col("ord").alias("doc_id"), o.insert_text(F.col("metadata")).alias("insert_text"), o.query_text(F.col("metadata")).alias("query_text"))


def with_vectors(v):
    vec = v.embeddings.select(F.col("vec_id").alias("ord"), "embedding")
    return store(v).join(vec, "ord").select("sample_id", "content", "metadata", "embedding", "ord")


@query("h03_batch_add", "SELECT replace(concat('d/', CAST(doc_id AS STRING)), '/', '_') AS sample_id FROM documents JOIN embeddings ON vec_id = doc_id")
def add(v):
    rows = with_vectors(v)
    old = rows.where("metadata['subgroup'] = 'en'").withColumn("sample_id", F.replace("sample_id", F.lit("/"), F.lit("_"))).drop("ord")
    return o.added(old, rows, 64)[0].select("sample_id")


@query("h03_rejected", "SELECT replace(concat('d/', CAST(doc_id AS STRING)), '/', '_') AS sample_id, 'exists' AS reason FROM documents JOIN embeddings ON vec_id = doc_id WHERE lang = 'en'")
def rejected(v):
    rows = with_vectors(v)
    old = rows.where("metadata['subgroup'] = 'en'").withColumn("sample_id", F.replace("sample_id", F.lit("/"), F.lit("_"))).drop("ord")
    return o.added(old, rows, 64)[1]


@query("h04_get", "SELECT concat('d_', CAST(doc_id AS STRING)) AS sample_id, md5(text) AS digest FROM documents WHERE lang = 'es'")
def get(v):
    rows = store(v).withColumn("sample_id", F.replace("sample_id", F.lit("/"), F.lit("_")))
    return o.got(rows, store(v).where("metadata['subgroup'] = 'es'")).select("sample_id", F.md5("content").alias("digest"))


@query("h04_list", "SELECT concat('d/', CAST(doc_id AS STRING)) AS sample_id FROM documents ORDER BY concat('d/', CAST(doc_id AS STRING)) LIMIT 25")
def first(v):
    return o.listed(store(v), 25).select("sample_id")


@query("h04_count", "SELECT count(*) AS n FROM documents")
def count(v):
    return o.counted(store(v))


@query("h14_list", "SELECT concat('d/', CAST(doc_id AS STRING)) AS sample_id, source AS benchmark FROM documents WHERE source = 'src1' ORDER BY concat('d/', CAST(doc_id AS STRING)) LIMIT 20")
def of_benchmark(v):
    return o.listed(store(v), 20, "src1").select("sample_id", F.col("metadata")["benchmark"].alias("benchmark"))


@query("h04_delete", "SELECT concat('d_', CAST(doc_id AS STRING)) AS sample_id FROM documents WHERE lang <> 'de'")
def delete(v):
    rows = store(v)
    safe = rows.withColumn("sample_id", F.replace("sample_id", F.lit("/"), F.lit("_")))
    return o.deleted(safe, rows.where("metadata['subgroup'] = 'de'")).select("sample_id")


@query("h05_update_metadata", "SELECT concat('d_', CAST(doc_id AS STRING)) AS sample_id, source AS benchmark, CASE WHEN lang = 'fr' THEN 'checked' ELSE CASE WHEN doc_id % 2 = 0 THEN 'open' ELSE 'multiple_choice' END END AS type FROM documents")
def update(v):
    rows = store(v).withColumn("sample_id", F.replace("sample_id", F.lit("/"), F.lit("_")))
    change = store(v).where("metadata['subgroup'] = 'fr'").select("sample_id", F.create_map(F.lit("type"), F.lit("checked")).alias("metadata"))
    return o.with_metadata(rows, change)[0].select("sample_id", F.col("metadata")["benchmark"].alias("benchmark"), F.col("metadata")["type"].alias("type"))


@query("h06_find_similar", f"WITH {HITS} SELECT query_id, sample_id, rank, round(similarity, 6) AS similarity FROM ranked WHERE rank <= 10")
def similar(v):
    return o.find_similar(vector_rows(v), asked(v), 10).withColumn("similarity", F.round("similarity", 6))


@query("h07_import", "SELECT vec_id AS sample_id, CASE WHEN label < 5 THEN 'new' ELSE 'old' END AS content FROM embeddings")
def imports(v):
    old = vector_rows(v).withColumn("content", F.lit("old"))
    return o.imported(old, old.where("benchmark < '5'").withColumn("content", F.lit("new"))).select("sample_id", "content")


@query("h08_similarity_matrix", "SELECT a.label, count(*) AS pairs, round(sum(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 3) AS total FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <= b.vec_id GROUP BY a.label")
def matrix(v):
    return o.similarity_pairs(v.embeddings, "label").groupBy("label").agg(F.count("*").alias("pairs"), F.round(F.sum("similarity"), 3).alias("total"))


@query("h09_diversity_per_generation")
def diversity(v):
    return o.gram_entropy(v.embeddings.select(F.col("label").alias("gen"), "embedding"), "gen", 1.0)


@query("h10_diversity_cumulative")
def diversity_cumulative(v):
    rows = v.active_pool.join(v.embeddings.select(F.col("vec_id").alias("task_number"), "embedding"), "task_number")
    return o.cumulative_entropy(rows, v.active_pool, 0.5)


@query("h11_projection")
def projection(v):
    return o.projected(v.embeddings, 5)[0]


DENSE = """u AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
  hits AS (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON round(list_cosine_similarity(a.e, b.e), 12) >= 0.35),
  dense AS (SELECT a AS id FROM hits GROUP BY a HAVING count(*) >= 3),
  links AS (SELECT a, b FROM hits WHERE a IN (SELECT id FROM dense) AND b IN (SELECT id FROM dense)),
  reach AS (SELECT id AS a, id AS b FROM dense UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
  least AS (SELECT a AS id, min(b) AS component FROM reach GROUP BY a),
  large AS (SELECT component, row_number() OVER (ORDER BY component) - 1 AS cluster FROM least GROUP BY component HAVING count(*) >= 3)"""


@query("h11_density_clusters", f"WITH RECURSIVE {DENSE} SELECT vec_id AS sample_id, CAST(coalesce(cluster, -1) AS INT) AS cluster FROM embeddings LEFT JOIN least ON id = vec_id LEFT JOIN large USING (component)")
def density(v):
    return clusters.density_clusters(v.embeddings.select(F.col("vec_id").alias("sample_id"), "embedding"), 0.35, 3, 3)


@query("h12_solved_by", "WITH s AS (SELECT task_number, count(*) FILTER (solved) AS n, string_agg(CASE WHEN solved THEN model_path END, ',' ORDER BY model_path) AS models FROM points WHERE gen < 2 GROUP BY task_number) SELECT task_number, coalesce(models, '') AS models, CASE WHEN n = 0 THEN 'none' WHEN n = 1 THEN 'one' ELSE 'many' END AS category FROM s")
def solved_by(v):
    return o.solved_by(v.points, v.archive.where("gen < 2")).select("task_number", F.array_join("models", ",").alias("models"), "category")


@query("h13_store_statistics", "SELECT source AS benchmark, CASE WHEN doc_id % 2 = 0 THEN 'open' ELSE 'multiple_choice' END AS type, count(*) AS n, count(DISTINCT lang) AS subgroups FROM documents GROUP BY ALL")
def statistics(v):
    return o.store_statistics(store(v))


@query("h14_search_preview", f"WITH {HITS}, m AS (SELECT r.query_id, r.sample_id, row_number() OVER (PARTITION BY r.query_id ORDER BY r.rank) AS place FROM ranked r JOIN embeddings e ON e.vec_id = r.sample_id WHERE r.rank <= 20 AND e.label = 3) SELECT query_id, place, sample_id, concat('text ', CAST(sample_id AS STRING)) AS preview FROM m WHERE place <= 10")
def preview(v):
    hits = o.find_similar(vector_rows(v), asked(v), 20)
    return o.search_preview(hits, vector_rows(v), "3", 10).drop("similarity")
