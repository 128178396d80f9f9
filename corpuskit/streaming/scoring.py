"""Scoring of arriving comments: the batch operators on an unbounded table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskit.functions.lexicon import UKRAINIAN
from corpuskit.functions.text import clean_for_model
from corpuskit.operators.score import apply_thresholds, logits_to_probs, score, verdict
from corpuskit.operators.weak import weak_label
from corpuskit.schema import LABELS


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None):
    """Files that appear under ``path`` as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def _not_blank(df: DataFrame, text: str) -> DataFrame:
    return df.where(F.coalesce(F.col(text), F.lit("")).rlike(r"(?U)\S"))


def score_stream(stream: DataFrame, load_model, text: str = "comment", thresholds=None) -> DataFrame:
    """Clean, score, threshold and phrase a verdict per comment; blank comments are skipped.

    Every step is stateless, so the query runs in append mode and needs no watermark.
    """
    scored = score(_not_blank(stream, text), load_model, text)
    return verdict(apply_thresholds(logits_to_probs(scored), thresholds))


def weak_label_stream(stream: DataFrame, lexicon=UKRAINIAN, text: str = "comment", row_id: str = "id") -> DataFrame:
    """Weak labels and a verdict per arriving comment."""
    cleaned = clean_for_model(_not_blank(stream, text), text)
    return verdict(weak_label(cleaned, lexicon, text, row_id), LABELS, prefix="")


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what has arrived, append it to ``path`` and stop."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
