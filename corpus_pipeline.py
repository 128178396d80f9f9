"""The training-data pipeline: documents in, packed token sequences out.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which :func:`run` writes as
Parquet into the shared folder and rereads as the next stage's ``docs``.  Stages have the columns
of ``documents`` (``doc_id, text, lang, source, n_chars``, and any further ones)
except the last.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.llm import language_id, packing, simhash, suffixes
from corpuskit.llm.common import bound_batches, table
from corpuskit.session import scratch_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what no learned language claims: texts that are null, have no letter or decode ambiguously.

    The classifiers are fitted on the labelled rows of ``docs`` itself; without any, no
    language is known and every row goes.
    """
    bound_batches(spark)
    found = language_id.predict(docs.withColumn("__row", F.struct(*docs.columns)).select("__row", "text"), language_id.fit(docs))
    clear = (F.col("lang_pred") != language_id.UNKNOWN) & ~F.col("ambiguous")
    return found.where(clear).select("__row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of every SimHash group (3-word shingles, 2 bits).

    Rows that share an id are one document and stay or go together; rows without an id cannot be
    named as copies and stay.
    """
    bound_batches(spark)
    found = simhash.near_duplicates(docs, shingle=3, max_bits=2)
    copies = found.where("doc_id != component_id").select("doc_id").distinct()
    first = found.where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(copies.join(first, "doc_id", "left_anti"), "doc_id", "left_anti").select(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut every 50-byte string that also starts in a document with a smaller id; all rows stay.

    ``n_chars`` follows the text; a null text stays null with its own ``n_chars``.
    """
    bound_batches(spark)
    cut = suffixes.without_repeats(docs, length=50)
    if "n_chars" in docs.columns:
        length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        cut = cut.withColumn("n_chars", F.coalesce(length, "n_chars"))
    return cut.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of every document, placed in sequences of at most 1024 tokens."""
    bound_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeated_passages),
    ("packing", pack_sequences),
]

#: Language identification and packing cannot be written in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
