import public_tokenizers
import pytest

TEXT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def byte_file():
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def piece_file():
    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="session")
def make(spark):
    """Documents of (id, text), over a few partitions; ``extra`` adds columns that clash with results."""

    def documents(rows, extra=()):
        df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], TEXT)
        for name in extra:
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit("mine"))
        return df.repartition(3, "doc_id") if rows else df

    return documents

