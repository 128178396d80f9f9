"""Exact multi-label metrics as aggregates.

Input rows hold a probability ``p_<label>`` and a truth ``y_<label>`` per label.
Confusion counts come from one aggregate.  The ranking metrics first collapse
rows to distinct (label, score) counts and then use bucketed running sums.
"""

from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpuskit.operators.ordering import running_sums
from corpuskit.operators.score import threshold_map
from corpuskit.schema import LABELS

# --- Fixed values: the threshold grid of the sweep ----------------------------
SWEEP = [float(t) for t in np.arange(0.1, 0.9, 0.05)]
# ------------------------------------------------------------------------------


def _ratio(top, bottom):
    """0 on zero division."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom), F.lit(0.0))


def _f1(tp, fp, fn):
    return _ratio(2 * tp, 2 * tp + fp + fn)


def _predicted(label, limits):
    return F.col(f"p_{label}") >= F.lit(limits[label])


def _counts(df: DataFrame, labels, limits) -> DataFrame:
    """One row: n, rows with every label right, and four counts per label."""
    parts = [F.count("*").alias("n")]
    right = []
    for c in labels:
        p, y = _predicted(c, limits), F.col(f"y_{c}") == 1
        parts += [
            F.count_if(p & y).alias(f"tp_{c}"),
            F.count_if(p & ~y).alias(f"fp_{c}"),
            F.count_if(~p & y).alias(f"fn_{c}"),
            F.count_if(~p & ~y).alias(f"tn_{c}"),
        ]
        right.append(p == y)
    return df.agg(*parts, F.count_if(reduce(and_, right)).alias("all_right"))


def confusion(df: DataFrame, labels: list[str] = LABELS, thresholds=0.5) -> DataFrame:
    counts = _counts(df, labels, threshold_map(thresholds, labels))
    names = ("tp", "fp", "fn", "tn")
    cells = [
        F.struct(F.lit(c).alias("label"), *[F.col(f"{k}_{c}").alias(k) for k in names]) for c in labels
    ]
    return counts.select(F.inline(F.array(*cells)))


def per_label_f1(df: DataFrame, labels: list[str] = LABELS, thresholds=0.5) -> DataFrame:
    counts = confusion(df, labels, thresholds)
    return counts.select("label", _f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"))


def aggregate_metrics(df: DataFrame, labels: list[str] = LABELS, thresholds=0.5) -> DataFrame:
    """Macro and micro scores, subset accuracy and Hamming loss, plus F1 per label; one row."""
    counts = _counts(df, labels, threshold_map(thresholds, labels))
    col = lambda kind, c: F.col(f"{kind}_{c}")
    add = lambda parts: reduce(lambda a, b: a + b, parts)
    f1 = {c: _f1(col("tp", c), col("fp", c), col("fn", c)) for c in labels}
    precision = [_ratio(col("tp", c), col("tp", c) + col("fp", c)) for c in labels]
    recall = [_ratio(col("tp", c), col("tp", c) + col("fn", c)) for c in labels]
    tp, fp, fn = (add([col(k, c) for c in labels]) for k in ("tp", "fp", "fn"))
    size = len(labels)
    return counts.select(
        (add(list(f1.values())) / size).alias("macro_f1"),
        _f1(tp, fp, fn).alias("micro_f1"),
        (add(precision) / size).alias("macro_precision"),
        (add(recall) / size).alias("macro_recall"),
        _ratio(F.col("all_right"), F.col("n")).alias("subset_accuracy"),
        _ratio(fp + fn, F.col("n") * size).alias("hamming_loss"),
        *[f1[c].alias(f"{c}_f1") for c in labels],
    )


def macro_metrics(df, labels=LABELS, thresholds=0.5) -> DataFrame:
    return aggregate_metrics(df, labels, thresholds).select("macro_f1", "macro_precision", "macro_recall")


def micro_f1(df, labels=LABELS, thresholds=0.5) -> DataFrame:
    return aggregate_metrics(df, labels, thresholds).select("micro_f1")


def subset_accuracy(df, labels=LABELS, thresholds=0.5) -> DataFrame:
    return aggregate_metrics(df, labels, thresholds).select("subset_accuracy")


def hamming_loss(df, labels=LABELS, thresholds=0.5) -> DataFrame:
    return aggregate_metrics(df, labels, thresholds).select("hamming_loss")


def _long(df: DataFrame, labels: list[str]) -> DataFrame:
    cells = [
        F.struct(
            F.lit(c).alias("label"),
            F.col(f"p_{c}").cast("double").alias("score"),
            F.col(f"y_{c}").cast("int").alias("truth"),
        )
        for c in labels
    ]
    return df.select(F.inline(F.array(*cells)))


def ranking_metrics(df: DataFrame, labels: list[str] = LABELS) -> DataFrame:
    """(label, roc_auc, pr_auc): ties count half in the former, the latter is the step form.

    Null where a label has no positive or no negative row, so the metric is undefined.
    """
    tied = _long(df, labels).groupBy("label", "score").agg(
        F.sum("truth").alias("p"), F.sum(1 - F.col("truth")).alias("n")
    )
    placed = running_sums(tied, ["label"], "score", ["p", "n"], descending=True)
    p, n, above_p, above_n = (F.col(c) for c in ("p", "n", "upto_p", "upto_n"))
    # products of counts exceed the range of long integers at scale
    wins = F.sum(n.cast("double") * ((above_p - p) + p / 2))
    steps = F.sum(p * above_p.cast("double") / (above_p + above_n))
    sums = placed.groupBy("label").agg(
        wins.alias("wins"), steps.alias("steps"), F.sum("p").alias("P"), F.sum("n").alias("N")
    )
    return sums.select(
        "label",
        F.try_divide(F.col("wins"), F.col("P").cast("double") * F.col("N")).alias("roc_auc"),
        F.when(F.col("P") > 0, F.col("steps") / F.col("P")).alias("pr_auc"),
    )


def roc_auc(df: DataFrame, labels: list[str] = LABELS) -> DataFrame:
    return ranking_metrics(df, labels).select("label", "roc_auc")


def average_precision(df: DataFrame, labels: list[str] = LABELS) -> DataFrame:
    return ranking_metrics(df, labels).select("label", "pr_auc")


def evaluate(
    df: DataFrame, labels: list[str] = LABELS, thresholds=0.5, zero_all_on_undefined: bool = False
) -> DataFrame:
    """One row: six aggregates and F1, ROC-AUC and PR-AUC per label.

    An undefined AUC is null; with ``zero_all_on_undefined`` one undefined label
    sets the ROC-AUC of all labels to 0 and an undefined PR-AUC is 0, as in the original report.
    """
    head = aggregate_metrics(df, labels, thresholds).withColumn("__one", F.lit(1))
    ranked = ranking_metrics(df, labels)
    picks = []
    for c in labels:
        mine = F.col("label") == c
        picks.append(F.max(F.when(mine, F.col("roc_auc"))).alias(f"{c}_roc_auc"))
        picks.append(F.max(F.when(mine, F.col("pr_auc"))).alias(f"{c}_pr_auc"))
    tail = ranked.agg(*picks, F.count("roc_auc").alias("__defined"))
    if zero_all_on_undefined:
        whole = F.col("__defined") == len(labels)
        tail = tail.withColumns(
            {f"{c}_roc_auc": F.when(whole, F.col(f"{c}_roc_auc")).otherwise(0.0) for c in labels}
        ).na.fill(0.0, [f"{c}_pr_auc" for c in labels])
    tail = tail.drop("__defined").withColumn("__one", F.lit(1))
    per_label = [f"{c}_{m}" for c in labels for m in ("f1", "roc_auc", "pr_auc")]
    summary = [
        "macro_f1", "micro_f1", "macro_precision", "macro_recall", "subset_accuracy", "hamming_loss",
    ]
    return head.join(tail, "__one").select(*summary, *per_label)


def threshold_sweep(df: DataFrame, labels: list[str] = LABELS, grid: list[float] = SWEEP) -> DataFrame:
    """(label, step, threshold, f1) for every grid value.

    A score only matters through how many thresholds it reaches, so the table
    collapses to at most 17 counts per label before thresholds are expanded.
    """
    reached = reduce(lambda a, b: a + b, [F.when(F.col("score") >= F.lit(t), 1).otherwise(0) for t in grid])
    counts = _long(df, labels).groupBy("label", reached.alias("reached")).agg(
        F.sum("truth").alias("p"), F.count("*").alias("rows")
    )
    steps = F.array(
        *[F.struct(F.lit(i).alias("step"), F.lit(t).alias("threshold")) for i, t in enumerate(grid)]
    )
    each = counts.select("*", F.inline(steps))
    over = F.col("reached") > F.col("step")
    tp = F.sum(F.when(over, F.col("p")).otherwise(0))
    fp = F.sum(F.when(over, F.col("rows") - F.col("p")).otherwise(0))
    fn = F.sum(F.when(~over, F.col("p")).otherwise(0))
    return each.groupBy("label", "step", "threshold").agg(_f1(tp, fp, fn).alias("f1"))


def optimize_thresholds(df: DataFrame, labels: list[str] = LABELS, grid: list[float] = SWEEP) -> DataFrame:
    """Best threshold per label (the first maximum of F1), with F1 at 0.5 and the gain."""
    first = W.partitionBy("label").orderBy(F.desc("f1"), "step")
    sweep = threshold_sweep(df, labels, grid).withColumn("__rank", F.row_number().over(first))
    best = sweep.where("__rank = 1").select("label", "threshold", F.col("f1").alias("best_f1"))
    base = per_label_f1(df, labels, 0.5).select("label", F.col("f1").alias("f1_at_half"))
    return best.join(base, "label").select(
        "label", "threshold", "f1_at_half", "best_f1", (F.col("best_f1") - F.col("f1_at_half")).alias("gain")
    )


def load_eval_table(spark, name: str, paths: dict[str, str]) -> DataFrame:
    """A test table by name."""
    if name not in paths:
        raise ValueError(f"Unknown dataset: {name}")
    return spark.read.parquet(paths[name])
