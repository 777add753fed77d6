"""Benchmark question queries."""

from pyspark.sql import functions as F

from evalspark.functions.hashing import draw, draw_sql
from evalspark.operators import questions as o
from evalspark.operators.vectors import added, hashed_embedding
from evalspark.plans.registry import query


def asked(v):
    return v.questions


@query("i01_stratified_sample", f"WITH r AS (SELECT benchmark, subgroup, idx, row_number() OVER (PARTITION BY benchmark, subgroup ORDER BY {draw_sql('idx', 1)}, idx) AS rank FROM questions) SELECT benchmark, subgroup, idx FROM r WHERE rank <= 10")
def stratified(v):
    return o.stratified(v.questions, 10, draw(F.col("idx"), 1), ("benchmark", "subgroup")).select("benchmark", "subgroup", "idx")


@query("i02_flat_sample", f"SELECT idx FROM questions ORDER BY {draw_sql('idx', 2)}, idx LIMIT 30")
def flat(v):
    return o.flat_sample(v.questions, 30, draw(F.col("idx"), 2)).select("idx")


BARE = "bare AS (SELECT idx, subgroup, CASE WHEN contains(question, chr(10) || 'Options:') THEN split_part(question, chr(10) || 'Options:', 1) ELSE split_part(question, ' Options:', 1) END AS text FROM questions), bad AS (SELECT DISTINCT b.subgroup, b.text FROM bare b JOIN invalid_questions i ON i.idx = b.idx)"


def invalid(v):
    return v.questions.join(v.invalid_questions, "idx").select("subgroup", "question")


@query("i03_valid_questions", f"WITH {BARE} SELECT idx FROM bare b WHERE NOT EXISTS (SELECT 1 FROM bad x WHERE x.subgroup = b.subgroup AND x.text = b.text)")
def valid(v):
    return o.valid_only(v.questions, invalid(v))[0].select("idx")


@query("i03_invalid_counts", f"WITH {BARE}, d AS (SELECT b.subgroup FROM bare b JOIN bad x ON x.subgroup = b.subgroup AND x.text = b.text) SELECT subgroup, count(*) AS count FROM d GROUP BY ROLLUP (subgroup)")
def invalid_counts(v):
    return o.valid_only(v.questions, invalid(v))[1]


@query("i04_question_ids", "SELECT idx, concat(lower(benchmark), '_', subgroup, '_', CAST(row_number() OVER (PARTITION BY benchmark, subgroup ORDER BY idx) - 1 AS STRING)) AS question_id FROM questions")
def ids(v):
    return o.question_ids(v.questions).select("idx", "question_id")


NUMBER, C = "CAST(idx AS STRING)", ["'alpha'", "'beta'", f"concat('item ', {'CAST(idx AS STRING)'})"]
QUESTION = "trim(coalesce(question, ''), ' ' || chr(10))"
BBH = "trim(coalesce(CASE WHEN contains(question, chr(10) || 'Options:') THEN split_part(question, chr(10) || 'Options:', 1) ELSE split_part(question, ' Options:', 1) END, ''), ' ' || chr(10))"
SHUFFLE = f"sh AS (SELECT q.idx, k.i, row_number() OVER (PARTITION BY q.idx ORDER BY {draw_sql('q.idx * 4 + k.i', 9)}, k.i) - 1 AS place, CASE WHEN k.i = 0 THEN 'right' ELSE concat('wrong ', CAST(k.i AS STRING)) END AS choice FROM questions q, (SELECT unnest([0, 1, 2, 3]) AS i) k), gp AS (SELECT idx, string_agg(concat(substring('ABCD', CAST(place AS INT) + 1, 1), ') ', choice), chr(10) ORDER BY place) AS lines, string_agg(choice, '|' ORDER BY place) AS choices, max(place) FILTER (i = 0) AS at_ FROM sh GROUP BY idx)"
LINES = "concat('A) alpha', chr(10), 'B) beta', chr(10), 'C) item ', CAST(idx AS STRING))"


def dataset(v, name: str):
    """The questions in the columns of a published data set."""
    number = F.col("idx").cast("string")
    choices = F.array(F.lit("alpha"), F.lit("beta"), F.concat(F.lit("item "), number))
    at = F.pmod("idx", F.lit(3)).cast("int")
    columns = {
        "mmlu": {"question": "question", "choices": choices, "answer": at},
        "mmlu_pro": {"question": "question", "options": choices, "answer": o.letter(at), "answer_index": at, "question_id": "idx", "src": "benchmark"},
        "bbh": {"input": "question", "target": F.concat(F.lit("t"), number)},
        "math": {"problem": "question", "level": F.concat(F.lit("Level "), number), "solution": F.concat(F.lit("s"), number), "type": "benchmark"},
        "gsm8k": {"question": "question", "answer": F.when(at > 0, F.concat(F.lit("so\n#### "), number, F.lit(" "))).otherwise(F.lit("none"))},
        "humaneval": {"prompt": "question", "task_id": F.concat(F.lit("H/"), number), "entry_point": F.lit("f"), "canonical_solution": F.lit("return")},
        "mbpp": {"text": "question", "task_id": "idx", "code": F.lit("pass"), "test_list": F.array(F.lit("assert"), number)},
        "gpqa": {"Question": "question", "Correct Answer": F.lit("right"), **{f"Incorrect Answer {i}": F.lit(f"wrong {i}") for i in (1, 2, 3)}, "Subdomain": "benchmark"},
    }[name]
    return v.questions.select("idx", "benchmark", "subgroup", *((F.col(c) if isinstance(c, str) else c).alias(k) for k, c in columns.items()))


CONTENTS = {
    "mmlu": f"trim(concat_ws(chr(10), question, {LINES}), ' ' || chr(10))",
    "mmlu_pro": f"trim(concat_ws(chr(10), question, {LINES}), ' ' || chr(10))",
    "bbh": BBH,
    **{name: QUESTION for name in ("math", "gsm8k", "humaneval", "mbpp")},
    "gpqa": "trim(concat_ws(chr(10), question, lines), ' ' || chr(10))",
}
AT = "CAST(idx % 3 AS STRING)"
FIELDS = {
    "mmlu": {"answer_index": AT, "answer_letter": "substring('ABC', CAST(idx % 3 AS INT) + 1, 1)", "answer_text": f"CASE idx % 3 WHEN 0 THEN {C[0]} WHEN 1 THEN {C[1]} ELSE {C[2]} END", "num_choices": "'3'", "question_type": "'multiple_choice'"},
    "mmlu_pro": {"answer_index": AT, "answer_letter": "substring('ABC', CAST(idx % 3 AS INT) + 1, 1)", "num_choices": "'3'", "original_question_id": NUMBER, "question_type": "'multiple_choice'", "source": "benchmark"},
    "bbh": {"answer": f"concat('t', {NUMBER})", "question_type": "'reasoning'"},
    "math": {"category_from_data": "benchmark", "difficulty": f"concat('Level ', {NUMBER})", "question_type": "'math_problem'", "solution": f"concat('s', {NUMBER})"},
    "gsm8k": {"answer": f"CASE WHEN idx % 3 > 0 THEN {NUMBER} ELSE 'none' END", "full_solution": f"CASE WHEN idx % 3 > 0 THEN concat('so', chr(10), '#### ', {NUMBER}, ' ') ELSE 'none' END", "question_type": "'math_word_problem'"},
    "humaneval": {"canonical_solution": "'return'", "entry_point": "'f'", "language": "'python'", "question_type": "'code_generation'", "task_id": f"concat('H/', {NUMBER})"},
    "mbpp": {"canonical_solution": "'pass'", "language": "'python'", "question_type": "'code_generation'", "task_id": NUMBER, "test_cases": f"concat('[\"assert\",\"', {NUMBER}, '\"]')"},
    "gpqa": {"answer_index": "CAST(at_ AS STRING)", "answer_letter": "substring('ABCD', CAST(at_ AS INT) + 1, 1)", "answer_text": "'right'", "difficulty": "''", "num_choices": "'4'", "question_type": "'multiple_choice'", "subdomain": "benchmark"},
}


def asked_of(name: str) -> None:
    """Registers the format and the metadata of one data set."""
    pairs = {"benchmark": f"'{name}'", "subgroup": "subgroup", **FIELDS[name]}
    joined = ", ".join(f"'{k}=', coalesce({pairs[k]}, ''), ';'" for k in sorted(pairs))
    head, rows = (f"WITH {SHUFFLE} ", "questions JOIN gp USING (idx)") if name == "gpqa" else ("", "questions")

    @query(f"i05_formatted_{name}", f"{head}SELECT idx, md5({CONTENTS[name]}) AS digest FROM {rows}")
    def content(v):
        return o.formatted(dataset(v, name), name).select("idx", F.md5(F.coalesce("content", F.lit(""))).alias("digest"))

    @query(f"i06_metadata_{name}", f"{head}SELECT idx, concat({joined}) AS entries FROM {rows}")
    def entries(v):
        line = lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")), F.lit(";"))
        rows = o.metadata(dataset(v, name), name)
        return rows.select("idx", F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), line), "").alias("entries"))


for _name in o.FORMATS:
    asked_of(_name)


@query("i07_shuffled_choices", f"WITH {SHUFFLE} SELECT idx, choices, substring('ABCD', CAST(at_ AS INT) + 1, 1) AS letter FROM gp")
def shuffled(v):
    rows = dataset(v, "gpqa")
    choices, at = o.gpqa_choices()
    return rows.select("idx", F.array_join(choices, "|").alias("choices"), o.letter(at).alias("letter"))


def all_datasets(v):
    """Questions dealt to the eight data sets, formatted, with metadata and ids."""
    parts = {}
    for i, name in enumerate(o.FORMATS):
        parts[name] = o.metadata(o.formatted(dataset(v, name).where(F.pmod("idx", F.lit(8)) == i), name), name)
    return o.question_store(parts)


STORED = f"WITH {SHUFFLE}, c AS (SELECT idx, subgroup, CASE idx % 8 " + " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(CONTENTS)) + " END AS dataset, CASE idx % 8 " + " ".join(f"WHEN {i} THEN {sql}" for i, sql in enumerate(CONTENTS.values())) + " END AS content FROM questions JOIN gp USING (idx)), ids AS (SELECT *, concat_ws('_', dataset, subgroup, CAST(row_number() OVER (PARTITION BY dataset, subgroup ORDER BY idx) - 1 AS STRING)) AS question_id FROM c)"


@query("i08_question_store_report", STORED + " SELECT dataset, count(*) FILTER (length(content) > 0) AS added, count(*) FILTER (length(content) = 0) AS failed FROM ids GROUP BY dataset")
def question_report(v):
    return all_datasets(v)[1]


@query("i08_question_store", STORED + " SELECT question_id AS sample_id, md5(content) AS digest, dataset AS benchmark FROM ids WHERE length(content) > 0")
def question_store(v):
    """All data sets, embedded and added to an empty store."""
    rows = all_datasets(v)[0].select(F.col("question_id").alias("sample_id"), "content", "metadata", hashed_embedding(F.col("content"), 8).alias("embedding"), F.xxhash64("question_id").alias("ord"))
    store = added(rows.drop("ord").limit(0), rows, 8)[0]
    return store.select("sample_id", F.md5("content").alias("digest"), F.col("metadata")["benchmark"].alias("benchmark"))


@query("i09_validity_report", "SELECT d.lang AS subject, count(*) FILTER (l.quality = 1) AS valid, count(*) FILTER (l.quality <> 1) AS invalid, count(*) FILTER (l.quality = 1) / count(*) AS valid_share, count(*) FILTER (l.quality <> 1) / count(*) AS invalid_share FROM documents d JOIN labels l USING (doc_id) GROUP BY d.lang")
def report(v):
    return o.validity_report(v.documents.join(v.labels, "doc_id").select(F.col("lang").alias("subject"), (F.col("quality") == 1).alias("valid")))
