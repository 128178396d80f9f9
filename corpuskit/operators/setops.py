"""Joins on ids, unions and first-wins deduplication."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def join_on_id(left: DataFrame, right: DataFrame, key: str | list[str] = "id") -> DataFrame:
    """Inner equi-join; the size-based choice of strategy is left to AQE."""
    return left.join(right, key, "inner")


def in_source(df: DataFrame, source: DataFrame, key: str | list[str] = "id") -> DataFrame:
    return df.join(_keys(source, key), key, "left_semi")


def not_in_source(df: DataFrame, source: DataFrame, key: str | list[str] = "id") -> DataFrame:
    """Rows of ``df`` whose id is not in ``source`` yet."""
    return df.join(_keys(source, key), key, "left_anti")


def _keys(df: DataFrame, key) -> DataFrame:
    return df.select(*([key] if isinstance(key, str) else key)).distinct()


def remove_holdout(
    selected: DataFrame, candidates: DataFrame | None, others: list[DataFrame], key: str = "id"
) -> list[DataFrame]:
    """The other tables without the held-out rows.

    The first table keeps only candidates that were not selected; every further
    table merely drops the selected ids.  ``None`` says that the first table is itself the
    table of candidates, and one anti-join does for it too.
    """
    if candidates is None:
        return [not_in_source(t, selected, key) for t in others]
    left_over = not_in_source(candidates, selected, key)
    first, *rest = others
    return [in_source(first, left_over, key)] + [not_in_source(t, selected, key) for t in rest]


def missing_ids(requested: DataFrame, received: DataFrame, keys: list[str] = ["batch_id", "id"]) -> DataFrame:
    """Requested (batch, id) pairs that no response delivered."""
    return not_in_source(requested.select(*keys), received, keys)


def union_same(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def union_missing(*frames: DataFrame) -> DataFrame:
    """Union of frames with differing columns; absent values become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def dedup_first(df: DataFrame, column: str, order_by: list) -> DataFrame:
    """First row per value of ``column`` in the given order.

    Texts are compared by their SHA-256 digest (missing text is one value too),
    so sorting handles short keys.  The literal ``= 1`` makes Spark drop all but
    one row per value in every map task before the shuffle: a value shared by a
    large part of the table costs one row per task.
    """
    digest, rank = "__digest", "__rank"
    first = W.partitionBy(digest).orderBy(*order_by)
    return (
        df.withColumn(digest, F.sha2(F.col(column).cast("string"), 256))
        .withColumn(rank, F.row_number().over(first))
        .where(F.col(rank) == 1)
        .drop(digest, rank)
    )


def upsert(existing: DataFrame, new: DataFrame, key: str = "id", order_by: list = []) -> DataFrame:
    """Add new rows by id; a row that exists already wins over its new version.

    The stored rows pass through as they are: only their ids meet the new rows, which are reduced to
    the first of each id in ``order_by`` (by all columns, unless given).
    """
    rank = "__rank"
    first = W.partitionBy(key).orderBy(*(order_by or [c for c in existing.columns if c != key]))
    once = new.withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1).drop(rank)
    return existing.unionByName(not_in_source(once, existing, key))
