"""Corpus profiling: each profile is one aggregate over the table."""

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.operators.ordering import running_sums
from corpuskit.operators.project import any_set, total
from corpuskit.schema import IDENTITIES, LABELS, PRIMARY_LABEL
from corpuskit.session import freeze


def _rows(df: DataFrame, *structs: Column) -> DataFrame:
    """Turn the single row of a wide aggregate into one row per struct."""
    return df.select(F.inline(F.array(*structs)))


def _set(column: str) -> Column:
    return F.col(column) == 1


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def count_where(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    return df.agg(*[F.count_if(c).alias(name) for name, c in conditions.items()])


def inconsistent_count(df: DataFrame, labels=LABELS, primary: str = PRIMARY_LABEL) -> DataFrame:
    """Rows that carry another label but not the primary one."""
    others = [c for c in labels if c != primary]
    return df.agg(F.count_if((F.col(primary) == 0) & (total(others) > 0)).alias("inconsistent"))


def category_distribution(df: DataFrame, columns: list[str] = LABELS) -> DataFrame:
    counts = df.agg(*[F.count_if(_set(c)).alias(c) for c in columns])
    pairs = [F.struct(F.lit(c).alias("category"), F.col(c).alias("n")) for c in columns]
    return _rows(counts, *pairs).orderBy(F.desc("n"), "category")


def value_counts(df: DataFrame, column: str, by_frequency: bool = False) -> DataFrame:
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), column) if by_frequency else counts.orderBy(column)


def co_occurrence(df: DataFrame, columns: list[str] = LABELS) -> DataFrame:
    """Counts of every ordered pair (a, b); only half of the matrix is computed."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    sums = df.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}|{b}") for a, b in pairs])
    full = pairs + [(b, a) for a, b in pairs if a != b]
    cell = lambda a, b: f"`{a}|{b}`" if (a, b) in pairs else f"`{b}|{a}`"
    return _rows(
        sums,
        *[
            F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(cell(a, b)).alias("n"))
            for a, b in full
        ],
    )


def _count_per_label(df: DataFrame, labels: list[str], condition) -> DataFrame:
    counts = df.agg(*[F.count_if(condition(c)).alias(c) for c in labels])
    return _rows(counts, *[F.struct(F.lit(c).alias("label"), F.col(c).alias("n")) for c in labels])


def pair_with_primary(df: DataFrame, labels=LABELS, primary: str = PRIMARY_LABEL) -> DataFrame:
    """Per label: rows that carry it, the primary label and exactly two labels in all."""
    return _count_per_label(df, labels, lambda c: _set(c) & _set(primary) & (total(labels) == 2))


def exclusive_count(df: DataFrame, labels=LABELS) -> DataFrame:
    """Per label: rows that carry this label alone."""
    return _count_per_label(df, labels, lambda c: _set(c) & (total(labels) == 1))


def describe(df: DataFrame, columns: list[str], by: list[str] = []) -> DataFrame:
    """count, mean, std (n - 1), min, linear quartiles and max, one row per column and group.

    Quartiles are exact order statistics: distinct values are counted and their
    running counts looked up, so no task ever holds all values of a group.
    """
    cells = [
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in columns
    ]
    values = df.select(*by, F.inline(F.array(*cells)))
    values = values.where(F.col("v").isNotNull() & ~F.isnan("v"))
    group = [*by, "column_name"]
    # one pass over the table; everything below works on distinct values
    counted = freeze(values.groupBy(*group, "v").agg(F.count("*").alias("rows")))
    n, weighted = F.sum("rows"), F.sum(F.col("v") * F.col("rows"))
    stats = counted.groupBy(*group).agg(
        n.alias("n"), (weighted / n).alias("mean"), F.min("v").alias("min"), F.max("v").alias("max")
    )
    spread = F.sum(F.col("rows") * (F.col("v") - F.col("mean")) ** 2)
    spread = counted.join(stats.select(*group, "mean"), group).groupBy(*group).agg(spread.alias("m2"))
    deviation = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))
    stats = stats.join(spread, group).withColumn("std", deviation)
    placed = running_sums(counted, group, "v", ["rows"]).join(stats.select(*group, "n"), group)

    def at(position):
        inside = (F.col("upto_rows") > position) & (F.col("upto_rows") - F.col("rows") <= position)
        return F.max(F.when(inside, F.col("v")))

    quartiles = []
    for name, share in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)):
        exact = (F.col("n") - 1) * F.lit(share)
        quartiles += [at(F.floor(exact)).alias(f"{name}_low"), at(F.ceil(exact)).alias(f"{name}_high")]
    ends = placed.groupBy(*group).agg(*quartiles)

    def between(name, share):
        exact = (F.col("n") - 1) * F.lit(share)
        low, high = F.col(f"{name}_low"), F.col(f"{name}_high")
        return (low + (high - low) * (exact - F.floor(exact))).alias(name)

    return stats.join(ends, group).select(
        *group,
        "n",
        "mean",
        "std",
        "min",
        between("p25", 0.25),
        between("p50", 0.5),
        between("p75", 0.75),
        "max",
    )


def label_correlation(df: DataFrame, columns: list[str] = LABELS) -> DataFrame:
    """Pearson correlation of every pair; null where a column is constant."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    values = df.agg(
        *[F.covar_pop(a, b).alias(f"{a}|{b}") for a, b in pairs],
        *[F.stddev_pop(c).alias(f"sd|{c}") for c in columns],
    )
    cells = []
    for a, b in pairs:
        r = F.try_divide(F.col(f"`{a}|{b}`"), F.col(f"`sd|{a}`") * F.col(f"`sd|{b}`"))
        cells.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r.alias("r")))
        if a != b:
            cells.append(F.struct(F.lit(b).alias("a"), F.lit(a).alias("b"), r.alias("r")))
    return _rows(values, *cells)


def nunique(df: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    """Distinct non-null values; exact counting shuffles digests instead of texts."""
    if approximate:
        return df.agg(F.approx_count_distinct(column).alias("n_unique"))
    return df.agg(F.count_distinct(F.sha2(F.col(column).cast("string"), 256)).alias("n_unique"))


def label_by_identity(df: DataFrame, identities=IDENTITIES, labels=LABELS) -> DataFrame:
    """Label counts among the rows of each identity, from one wide aggregate."""
    counts = df.agg(
        *[F.count_if(_set(i) & _set(c)).alias(f"{i}|{c}") for i in identities for c in labels]
    )
    return _rows(
        counts,
        *[
            F.struct(F.lit(i).alias("identity"), *[F.col(f"`{i}|{c}`").alias(c) for c in labels])
            for i in identities
        ],
    )


def cooccurrence_size_by_label(df: DataFrame, labels=LABELS) -> DataFrame:
    """How many labels the rows of each label carry."""
    sizes = df.groupBy("label_count").agg(*[F.count_if(_set(c)).alias(c) for c in labels])
    cells = [F.struct(F.lit(c).alias("label"), F.col(c).alias("n")) for c in labels]
    return sizes.select("label_count", F.inline(F.array(*cells))).where("n > 0")


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width bins between the extremes; the last bin is closed. Empty bins have n = 0."""
    counted = freeze(df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("rows")))
    low, high, width = _extent(counted, column, bins)
    place = F.floor((F.col(column) - low) / width).cast("int")
    filled = counted.groupBy(F.least(place, F.lit(bins - 1)).alias("bin")).agg(F.sum("rows").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(filled, "bin", "left").select(
        "bin",
        (low + F.col("bin") * width).alias("bin_start"),
        (low + (F.col("bin") + 1) * width).alias("bin_end"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
    )


def _extent(counted: DataFrame, column: str, bins: int):
    ends = counted.agg(F.min(column).alias("low"), F.max(column).alias("high")).first()
    if ends["low"] is None:
        return F.lit(0.0), F.lit(1.0), F.lit(1.0 / bins)
    low, high = float(ends["low"]), float(ends["high"])
    if low == high:
        low, high = low - 0.5, high + 0.5
    return F.lit(low), F.lit(high), F.lit((high - low) / bins)


def density(df: DataFrame, column: str, points: int = 200) -> DataFrame:
    """Gaussian density estimate on an even grid between the extremes (Scott's bandwidth).

    The kernel sums run over distinct values with their frequency, all grid points in one aggregate;
    the table itself is scanned once.
    """
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v"))
    counted = freeze(counted.agg(F.count("*").alias("rows")))
    rows, v = F.col("rows"), F.col("v")
    stats = counted.agg(
        F.sum(rows).alias("n"), (F.sum(rows * v) / F.sum(rows)).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high")
    ).first()
    if (stats["n"] or 0) < 2 or stats["low"] == stats["high"]:
        return df.sparkSession.createDataFrame([], "grid_point int, x double, density double")
    squares = counted.agg(F.sum(rows * (v - F.lit(stats["mean"])) ** 2)).first()[0]
    width = math.sqrt(squares / (stats["n"] - 1)) * stats["n"] ** -0.2
    step = (stats["high"] - stats["low"]) / (points - 1)
    scale = stats["n"] * width * math.sqrt(2 * math.pi)
    places = [stats["low"] + i * step for i in range(points)]
    sums = [F.sum(rows * F.exp(-0.5 * ((F.lit(x) - v) / F.lit(width)) ** 2)) / F.lit(scale) for x in places]
    cells = F.array(*[F.struct(F.lit(i).alias("grid_point"), F.lit(x).alias("x"), F.col(f"s{i}").alias("density")) for i, x in enumerate(places)])
    return counted.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).select(F.inline(cells))


def split_stats(df: DataFrame, name: str, labels=LABELS) -> DataFrame:
    toxic = F.avg(any_set(labels).cast("double"))
    return df.agg(F.count("*").alias("total"), toxic.alias("toxic_ratio")).select(
        F.lit(name).alias("split"), "total", "toxic_ratio"
    )


def split_stats_of(flagged: DataFrame, labels=LABELS) -> DataFrame:
    """The statistics of the whole table and of both sides of ``is_test``, from one scan."""
    name = F.when(F.col("is_test") == 1, "Test").when(F.col("is_test") == 0, "Train").otherwise("Full")
    toxic = F.avg(any_set(labels).cast("double"))
    sums = flagged.rollup("is_test").agg(F.count("*").alias("total"), toxic.alias("toxic_ratio"))
    return sums.select(name.alias("split"), "total", "toxic_ratio")


def num_retained(df: DataFrame) -> DataFrame:
    kept = _set("keep")
    return df.agg(
        F.count_if(kept).alias("kept"),
        F.count_if(kept & (F.col("category_count") > 0)).alias("kept_with_identity"),
    )


def class_weights(df: DataFrame, labels=LABELS) -> DataFrame:
    """Negative/positive ratio per label with both counts and shares in percent."""
    sums = df.agg(F.count("*").alias("__n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in labels])
    n = F.col("__n")
    cells = []
    for c in labels:
        pos, neg = F.col(c), n - F.col(c)
        cells.append(
            F.struct(
                F.lit(c).alias("label"),
                pos.alias("positive"),
                neg.alias("negative"),
                F.try_divide(100.0 * pos, n).alias("positive_pct"),
                F.try_divide(100.0 * neg, n).alias("negative_pct"),
                (neg / (pos + F.lit(1e-5))).alias("weight"),
            )
        )
    return _rows(sums, *cells)
