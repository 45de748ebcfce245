"""Documents to packed training sequences: quality, near duplicates, repeated text, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talktable.llm import packing, quality, simhash, substring
from talktable.llm.queries import tokenizer_file
from talktable.storage import materialize


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled ones among them, does not reject.

    Null and empty texts have the features zero, and their score decides like any other. Rows that repeat share their fate, rows with a null
    id are scored and not learned from. Extra columns stay as they are, and an empty table gives an empty one.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the smallest id: five-word shingles, similarity of 0.8 or more.

    SimHash and the ring give the first candidates, a lossless filter the rest, and whole shingle sets decide. Null, empty and blank texts are one
    group. Rows that share an id are one document and stay together; rows with a null id stay. Extra columns stay as they are, and
    an empty table gives an empty one.
    """
    return simhash.keep_representatives(docs, width=5, similarity=0.8)


def without_repeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines and passages that an earlier document or place has are cut out; documents stay, with their new length.

    Null texts stay null, with a null length. Equal rows of one id lose the same text. Rows with a null id stay as they are. Extra columns
    stay, one named ``removed`` too, and an empty table gives an empty one.
    """
    cut = substring.drop_repeated_units(docs, removed="removed_spans_of_this_stage")
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts in sequences of 2,048 tokens.

    A null or empty text is its closing token. Each of several equal rows is packed; an empty table gives no piece. Only ids and texts are read.
    """
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), keep_ids=False, added_tokens=True).drop("ids")


STAGES = [
    ("quality classifier", good_documents),
    ("simhash near-dedup", distinct_documents),
    ("substring dedup", without_repeated_text),
    ("packing", packed),
]
#: Trained scores, fingerprints and token ids have no SQL; the tests run the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each stage's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
