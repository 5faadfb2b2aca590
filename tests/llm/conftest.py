import pytest

from facsimile.llm.queries import ready

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(autouse=True)
def workers(spark):
    ready(spark)


@pytest.fixture
def documents(spark):
    """Makes a documents table of (doc_id, text[, source]), with further columns that clash with
    names the operators use inside."""

    def make(rows, **extra):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        for name in ("key", "size", "node", "row", "part", "spans", "kept", "n_tokens", "target", "words", "place", "print"):
            df = df.withColumn(name, df.doc_id.cast("string"))
        return df.repartition(3)

    return make


@pytest.fixture
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")
