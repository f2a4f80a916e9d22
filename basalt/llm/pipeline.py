"""The corpus pipeline: language, near copies, personal data, mixture, packing, each stage written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, text_batches
from .langid import identify, learn
from .mixing import mixed_documents
from .neardup import one_of_each
from .packing import pack_documents
from .pii import find_personal_data

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: The session's setting that stages change.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told apart clearly, with that language as ``lang``; the rejected ones go.

    So do texts that are null or have no letter; repeated rows are judged alike; an empty table gives no rows; very long
    texts are judged whole; extra columns are left out.
    """
    text_batches(spark)
    told = identify(docs, learn(docs), list(COLUMNS)).where(~F.col("rejected"))
    return told.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (0.8 or more of all five-word shingles in common) one document, by ``one_of_each``.

    Null and empty texts are one group; repeated rows are one document; an empty table gives no rows.
    """
    text_batches(spark)
    return one_of_each(docs.select(*COLUMNS))


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and terms that disclose it replaced; null texts stay null, with 0 characters."""
    text_batches(spark)
    clean = find_personal_data(docs, ["doc_id", "lang", "source"])
    return clean.select("doc_id", F.col("clean_text").alias("text"), "lang", "source", F.coalesce(F.char_length("clean_text"), F.lit(0)).cast("long").alias("n_chars"))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, as whole documents, repeated ones and parts; of null and empty texts nothing is taken.

    Repeated rows are documents each; an empty table gives no rows; very long texts are cut where their quota ends.
    """
    text_batches(spark)
    return mixed_documents(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences with their token ids; a null or empty text is the one id that ends it.

    Repeated rows are packed each; an empty table gives no rows; very long texts fill several sequences.
    """
    text_batches(spark)
    return pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_copies),
    ("personal_data", remove_personal_data),
    ("mixture", mix_to_weights),
    ("packing", pack),
]

#: Compression sizes, token ids and the redaction of texts have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; the session's batch size is put back afterwards."""
    before = spark.conf.get(BATCH)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    spark.conf.set(BATCH, before)
    return docs
