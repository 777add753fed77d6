import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def table(spark):
    """Documents from texts (or pairs of id and text), with an extra column whose name clashes with inner ones."""

    def make(texts, extra=True):
        rows = [(x if isinstance(x, tuple) else (i, x)) for i, x in enumerate(texts)]
        df = spark.createDataFrame([(i, t, "en", None if (i or 0) % 3 == 2 else f"s{(i or 0) % 3}", len(t or "")) for i, t in rows], SCHEMA)
        return df.selectExpr("*", "'x' AS rep", "1 AS u", "2 AS bucket", "3 AS size", "'y' AS words") if extra else df

    return make


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
