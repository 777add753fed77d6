"""Parser and label queries over whole texts."""

from pyspark.sql import functions as F

from evalspark.functions import text as t
from evalspark.plans.registry import query

RAW = r"raw AS (SELECT conv_id, turn, text, CASE conv_id % 4 WHEN 0 THEN concat(text, ' \boxed{', CAST(turn AS STRING), '}') WHEN 1 THEN concat(text, ' #### ', CAST(turn AS STRING)) WHEN 2 THEN concat(text, ' Answer: ', CAST(turn AS STRING)) ELSE text END AS raw_output FROM assistant_texts)"


def raw(v):
    n, k = F.col("turn").cast("string"), F.col("conv_id") % 4
    out = F.when(k == 0, F.concat("text", F.lit(" \\boxed{"), n, F.lit("}"))).when(k == 1, F.concat("text", F.lit(" #### "), n)).when(k == 2, F.concat("text", F.lit(" Answer: "), n)).otherwise(F.col("text"))
    return v.assistant_texts.withColumn("raw_output", out)


@query("b02_correct_rules", "SELECT doc_id, quality = 1 AS correct, toxic > 0 AS correct_rate FROM labels")
def correct(v):
    return v.labels.select("doc_id", t.is_correct(F.col("quality")).alias("correct"), t.is_correct_rate(F.col("toxic")).alias("correct_rate"))


@query("b03_rates", "SELECT doc_id, (quality + toxic) / 2 AS rate FROM labels")
def rates(v):
    return v.labels.select("doc_id", t.mean_of(F.array(F.col("quality") == 1, F.col("toxic") == 1)).alias("rate"))


@query("b04_composite_ids", "SELECT doc_id, concat(lang, '_', CAST(doc_id AS STRING)) AS sample_id, concat(source, '_x') AS file_group FROM documents")
def ids(v):
    file = F.concat(F.lit("samples_bbh_"), "source", F.lit("_x_2025-01"))
    return v.documents.select("doc_id", t.composite_id(F.col("lang"), F.col("source"), doc_id=F.col("doc_id")).alias("sample_id"), t.group_of_file(file, "samples_bbh_").alias("file_group"))


@query("b05_metric_spec", "SELECT doc_id, source AS metric, lang AS filter FROM documents")
def spec(v):
    metric, name = t.metric_spec(F.concat_ws(",", "source", "lang"))
    return v.documents.select("doc_id", metric.alias("metric"), name.alias("filter"))


@query("b06_model_names", "SELECT doc_id, concat(lang, '_', source) AS marked, source AS plain FROM documents")
def names(v):
    return v.documents.select("doc_id", t.model_name(F.concat(F.lit("run__models__"), "lang", F.lit("_"), "source")).alias("marked"), t.model_name(F.concat(F.lit("/a/"), "lang", F.lit("/"), "source", F.lit("/"))).alias("plain"))


@query("b07_seed_models", "SELECT doc_id, lang <> 'en' AS seed, lang NOT IN ('en', 'de') AS seed_label FROM documents")
def seeds(v):
    name = F.when(F.col("lang") == "en", "gen_3_ind_12").when(F.col("lang") == "de", "x_gen_3").otherwise(F.col("source"))
    return v.documents.select("doc_id", t.is_seed_model(name).alias("seed"), t.is_seed_label(name).alias("seed_label"))


@query("b08_generations", "SELECT ord, gen FROM archive")
def generations(v):
    return v.archive.select("ord", t.generation(F.col("model_path")).alias("gen"))


@query("b09_task_numbers", "SELECT task_number, task_number AS number, -1 AS sentinel FROM tasks")
def numbers(v):
    return v.tasks.select("task_number", t.task_number(F.col("task_id")).alias("number"), t.task_number(F.col("generation_type")).alias("sentinel"))


CHAT = ("<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>")


@query("b10_strip_chat", "SELECT conv_id, turn, trim(text, ' ' || chr(10) || chr(9) || chr(13)) AS question FROM conversations")
def strip(v):
    whole = F.concat(F.lit("<s><|system|>be brief<|user|>"), "text", F.lit("</s><|assistant|>"))
    return v.conversations.select("conv_id", "turn", t.strip_chat(whole, *CHAT).alias("question"))


@query("b11_question_and_answer", "SELECT conv_id, turn, trim(text, ' ' || chr(10) || chr(9) || chr(13)) AS answer FROM conversations")
def answer(v):
    v_ = F.parse_json(F.to_json(F.struct(F.array(F.array("text")).alias("resps"), F.array("text").alias("filtered_resps"))))
    nested = F.coalesce(F.try_variant_get(v_, "$.resps[0][0]", "string"), F.try_variant_get(v_, "$.filtered_resps[0]", "string"))
    return v.conversations.select("conv_id", "turn", F.trim(nested, F.lit(" \n\t\r")).alias("answer"))


@query("b12_extract_answer", f"WITH {RAW} SELECT conv_id, turn, CASE WHEN conv_id % 4 IN (0, 1) THEN CAST(turn AS STRING) WHEN conv_id % 4 = 2 THEN concat(' ', CAST(turn AS STRING)) ELSE 'No answer found.' END AS answer FROM raw")
def extract(v):
    return raw(v).select("conv_id", "turn", t.extract_answer(F.col("raw_output")).alias("answer"))


@query("b13_json_block", "SELECT doc_id, lang, source FROM documents")
def block(v):
    body = F.to_json(F.struct("lang", "source"))
    whole = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("so:\n```json\n"), body, F.lit("\n```\n{broken"))).otherwise(F.concat(F.lit("it is {x} or "), body))
    found = F.try_parse_json(t.json_block(whole))
    return v.documents.select("doc_id", F.try_variant_get(found, "$.lang", "string").alias("lang"), F.try_variant_get(found, "$.source", "string").alias("source"))


@query("b14_judge_decisions", "SELECT sample_id, CASE WHEN sample_id % 7 = 0 THEN -1 ELSE sample_id % 5 END AS choice, CASE sample_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE -1 END AS pair, sample_id % 5 AS score, sample_id % 2 = 0 AS yes FROM verdicts")
def decisions(v):
    n = F.col("sample_id")
    pair = F.when(n % 3 == 0, "I say [[A]]").when(n % 3 == 1, "so [[B]]!").otherwise("none")
    yes = F.when(n % 2 == 0, "well\nDECISION: yes").otherwise("Decision: No")
    last = F.coalesce(t.decision_last_line(yes), t.decision_yes(yes))
    return v.verdicts.select("sample_id", t.decision_index(F.col("response")).alias("choice"), t.decision_pair(pair).alias("pair"), t.decision_score(F.concat(F.lit("[["), (n % 5).cast("string"), F.lit("]]"))).alias("score"), last.alias("yes"))


@query("b15_open_question_verdicts", "SELECT doc_id, quality = 1 AS valid FROM labels")
def verdicts(v):
    return v.labels.select("doc_id", t.valid_open_question(F.when(F.col("quality") == 1, "fine. DECISION: Yes").otherwise("DECISION: No, not Maybe")).alias("valid"))


@query("b16_option_parsing", "SELECT doc_id, lang AS question, 'Yes|No|maybe' AS options FROM documents")
def options(v):
    q, o = t.split_options(F.concat("lang", F.lit("\nOptions:\n- Yes\n- No\n maybe ")))
    return v.documents.select("doc_id", q.alias("question"), F.array_join(o, "|").alias("options"))


@query("b17_without_options", "SELECT doc_id, text AS question FROM documents")
def bare(v):
    return v.documents.select("doc_id", t.without_options(F.concat("text", F.lit("\nOptions:\n(A) x"))).alias("question"))


@query("b18_describe", "SELECT doc_id, concat('Lang: ', lang, chr(10), 'Source: ', source) AS description FROM documents")
def describe(v):
    fields = F.create_map(F.lit("lang"), "lang", F.lit("task_family"), F.lit("x"), F.lit("source"), "source", F.lit("done"), F.lit("no"))
    return v.documents.select("doc_id", t.describe(fields).alias("description"))


@query("b19_labels", "SELECT doc_id, concat(lang, '_', source) AS safe, concat(lang, '_', source) AS id, 'Adaptation Novel' AS title, CASE WHEN lang = 'en' THEN 'English' ELSE lang END AS short FROM documents")
def labels(v):
    return v.documents.select("doc_id", t.safe_name(F.concat_ws("?", "lang", "source")).alias("safe"), t.safe_id(F.concat_ws("/", "lang", "source")).alias("id"), t.title(F.lit("adaptation_novel")).alias("title"), t.short_label(F.col("lang"), [("en", "English")]).alias("short"))
