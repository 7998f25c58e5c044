"""A corpus pipeline from raw documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; :func:`run` writes it as
Parquet and reads it again as the next stage's ``docs``. All stages but the last return the
columns of documents, and each works on everything that its predecessor kept:

1. quality: documents that the classifier rejects go;
2. exact: one document of each set of equal texts stays;
3. near: one document of each near-duplicate class stays;
4. secrets: every secret found is replaced in the text, and ``n_chars`` follows;
5. packing: the documents that are left become sequences of at most 2048 tokens.

Defined results: null text counts as empty in every stage and stays null where the document stays;
empty texts are scored, equal to each other, near nothing, without secrets, and packed as their end
token; very long texts are taken whole; of equal texts the longest original stays, then the smallest
id, and of near classes the smallest id; rows that repeat an id and a text leave one row, rows that
repeat an id with different texts are documents of their own; rows without an id pass the near stage;
an empty table gives an empty result; columns beyond those of documents are carried along, whatever
their names, up to packing, which returns its own.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diachron.llm import exact_dedup, near_dedup, quality, secret_scan
from diachron.llm.queries import labels, packed
from diachron.storage import Scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, labels(spark, sf_dir))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one_of_each(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one_of_each(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else clean


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs)


STAGES = [("quality", quality_stage), ("exact", exact_stage), ("near", near_stage), ("secrets", secret_stage), ("packing", packing_stage)]

#: A learned model and similarity classes are beyond SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's table goes once the next one is written."""
    store = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        kept = store.save(stage(spark, docs, sf_dir))
        store.drop(docs)
        docs = kept
    return docs
