"""Model input, scoring and turning scores into labels and verdicts."""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.text import clean_for_model
from corpuskit.operators.sample import shuffle
from corpuskit.schema import DEFAULT_THRESHOLDS, LABEL_NAMES_UK, LABELS, TEXT_COL

# --- Fixed values: verdict texts ----------------------------------------------
VERDICT_CLEAN = "🟢 The comment is non-toxic."
VERDICT_TOXIC = "🔴 The comment is toxic."
VERDICT_CATEGORIES = " It belongs to the following toxicity categories:\n"
VERDICT_BULLET = "  🔸 "
# ------------------------------------------------------------------------------


def word_tokens(text: Column, max_length: int | None = None) -> Column:
    """Default tokeniser: all white-space words, or the first ``max_length`` if the caller wants a limit."""
    words = F.regexp_extract_all(text, F.lit(r"(?U)(\S+)"), F.lit(1))
    return words if max_length is None else F.slice(words, 1, max_length)


def build_model_input(
    df: DataFrame,
    text: str = TEXT_COL,
    labels: list[str] = LABELS,
    tokenizer: Callable[[Column, int | None], Column] = word_tokens,
    max_length: int | None = None,
    seed: int = 42,
    row_id: str = "id",
) -> DataFrame:
    """Shuffled ``(id, tokens, labels)``; the tokeniser maps a Column to an array Column."""
    vector = F.array(*[F.col(c).cast("float") for c in labels])
    rows = shuffle(df.select(row_id, text, *labels), seed, row_id)
    return rows.select(row_id, tokenizer(F.col(text), max_length).alias("tokens"), vector.alias("labels"))


def score(
    df: DataFrame,
    load_model: Callable[[], Callable[[pd.Series], "object"]],
    text: str = TEXT_COL,
    labels: list[str] = LABELS,
    clean: bool = True,
) -> DataFrame:
    """Add one logit column ``z_<label>`` per label.

    ``load_model()`` runs once per Python worker task and returns
    ``model(texts) -> N x L logits``.  Only the cleaned text travels to Python, in Arrow batches.
    """
    ready, logits = "__ready", "__logits"
    rows = df.withColumn(ready, F.col(text))
    rows = clean_for_model(rows, ready) if clean else rows

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_model()
        for batch in batches:
            values = np.asarray(model(batch.fillna("")), dtype="float64")
            yield pd.Series(list(values), index=batch.index)

    scored = rows.withColumn(logits, run.asNondeterministic()(ready))
    return scored.select(*df.columns, *[F.col(logits)[i].alias(f"z_{c}") for i, c in enumerate(labels)])


def sigmoid(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit.cast("double")))


def logits_to_probs(df: DataFrame, labels: list[str] = LABELS, digits: int | None = 4) -> DataFrame:
    """Add ``p_<label>`` columns, rounded unless ``digits`` is None."""
    def prob(c):
        p = sigmoid(F.col(f"z_{c}"))
        return p if digits is None else F.round(p, digits)

    return df.withColumns({f"p_{c}": prob(c) for c in labels})


def label_map(df: DataFrame, prefix: str, out: str, labels: list[str] = LABELS) -> DataFrame:
    """Collect ``<prefix><label>`` columns into a map keyed by label."""
    keys = F.array(*[F.lit(c) for c in labels])
    return df.withColumn(out, F.map_from_arrays(keys, F.array(*[F.col(prefix + c) for c in labels])))


def threshold_map(thresholds: float | dict | list | None, labels: list[str] = LABELS) -> dict[str, float]:
    if thresholds is None:
        return {c: DEFAULT_THRESHOLDS[c] for c in labels}
    if isinstance(thresholds, dict):
        return {c: float(thresholds[c]) for c in labels}
    if isinstance(thresholds, (list, tuple)):
        return dict(zip(labels, map(float, thresholds), strict=True))
    return {c: float(thresholds) for c in labels}


def apply_thresholds(df: DataFrame, thresholds=None, labels: list[str] = LABELS, out: str = "b_") -> DataFrame:
    """Add 0/1 columns from the probability columns as they are (rounded ones in inference)."""
    limits = threshold_map(thresholds, labels)
    return df.withColumns(
        {f"{out}{c}": F.when(F.col(f"p_{c}") >= F.lit(limits[c]), 1).otherwise(0) for c in labels}
    )


def verdict(df: DataFrame, labels: list[str] = LABELS, prefix: str = "b_", out: str = "verdict") -> DataFrame:
    """Readable verdict; the primary label says no more than "toxic" itself."""
    hit = F.array_compact(F.array(*[F.when(F.col(prefix + c) == 1, F.lit(c)) for c in labels]))
    named = F.transform(
        F.array_remove(hit, "toxic"),
        lambda c: F.concat(F.lit(VERDICT_BULLET), F.upper(F.replace(c, F.lit("_"), F.lit(" ")))),
    )
    details = F.when(F.size(named) > 0, F.concat(F.lit(VERDICT_CATEGORIES), F.array_join(named, "\n")))
    toxic = F.concat(F.lit(VERDICT_TOXIC), F.coalesce(details, F.lit("")))
    return df.withColumn(out, F.when(F.size(hit) > 0, toxic).otherwise(F.lit(VERDICT_CLEAN)))


def label_name(label: Column, lang: str = "uk") -> Column:
    """Display name of a label: the Ukrainian one, or English title case."""
    if lang == "uk":
        names = F.create_map(*[F.lit(x) for pair in LABEL_NAMES_UK.items() for x in pair])
        return F.coalesce(F.try_element_at(names, label), label)
    if lang == "en":
        return F.initcap(F.replace(label, F.lit("_"), F.lit(" ")))
    raise ValueError(f"Unknown language: {lang}")
