"""Column selection, renaming, row predicates and per-row counts."""

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.schema import IDENTITIES, LABELS


def select_cols(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns)


def keep_only(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop every column outside the keep-list; absent names are ignored."""
    return df.select(*[c for c in df.columns if c in columns])


def align_names(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def add_missing(df: DataFrame, columns: list[str], value=0) -> DataFrame:
    return df.withColumns({c: F.lit(value) for c in columns if c not in df.columns})


def binary(score: str | Column, threshold: float = 0.5) -> Column:
    """1 where the score reaches the threshold; missing and NaN give 0."""
    score = F.col(score) if isinstance(score, str) else score
    known = score.isNotNull() & ~F.isnan(score.cast("double"))
    return F.when(known & (score >= threshold), 1).otherwise(0)


def binarize(df: DataFrame, columns: list[str], threshold: float = 0.5) -> DataFrame:
    return df.withColumns({c: binary(c, threshold) for c in columns})


def drop_unlabelled(df: DataFrame, labels: list[str] = LABELS) -> DataFrame:
    """Drop rows where any label is the -1 sentinel (a missing label is no sentinel)."""
    return df.where(reduce(and_, [F.coalesce(F.col(c) != -1, F.lit(True)) for c in labels]))


def drop_null_text(df: DataFrame, column: str = "comment_text") -> DataFrame:
    return df.na.drop(subset=[column])


def drop_blank(df: DataFrame, column: str = "comment_text") -> DataFrame:
    return df.where(~F.col(column).rlike(r"(?U)\A[\s\x1c-\x1f]*\z"))


def total(columns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) for c in columns])


def any_set(columns: list[str]) -> Column:
    """True where any of the 0/1 columns is set."""
    return F.coalesce(F.greatest(*columns) if len(columns) > 1 else F.col(columns[0]), F.lit(0)) > 0


def row_count(df: DataFrame, columns: list[str], out: str) -> DataFrame:
    return df.withColumn(out, total(columns))


def segment(labels: list[str] = LABELS, identities: list[str] = IDENTITIES) -> Column:
    return (
        F.when(total(labels) > 0, "toxic").when(total(identities) > 0, "identity").otherwise("plain")
    )


def corpus_segment(df: DataFrame, labels=LABELS, identities=IDENTITIES, out: str = "segment") -> DataFrame:
    return df.withColumn(out, segment(labels, identities))


def stratum(toxicity: list[str] = LABELS, identities: list[str] = IDENTITIES) -> Column:
    """Toxic x identity as one of four names."""
    side = F.when(any_set(identities), "identity").otherwise("plain")
    return F.concat(F.when(any_set(toxicity), "toxic_").otherwise("clean_"), side)


def plain_condition(max_words: int = 400, word: str = "wikipedia", text: str = "comment_text") -> Column:
    mentions = F.coalesce(F.lower(text).contains(word.lower()), F.lit(False))
    return (F.col("comment_length") <= max_words) & ~mentions


def plain_filter(df: DataFrame, max_words: int = 400, word: str = "wikipedia", text: str = "comment_text") -> DataFrame:
    """Short comments that do not mention ``word``; missing text mentions nothing."""
    return df.where(plain_condition(max_words, word, text))


def seed_keep(df: DataFrame, out: str = "keep") -> DataFrame:
    """Keep rare rows up front: more than three labels, severe toxicity or threats."""
    rare = (F.col("label_count") > 3) | (F.col("severe_toxic") == 1) | (F.col("threat") == 1)
    return df.withColumn(out, F.when(rare, 1).otherwise(0))


def null_report(df: DataFrame) -> DataFrame:
    """Nulls per column from one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    pairs = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in df.columns]
    return counts.select(F.inline(F.array(*pairs)))
