"""Composite jobs: the plans a user calls, made of the operators."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.lexicon import UKRAINIAN
from corpuskit.functions.text import clean_for_model, clean_for_translation, scrub_pii, word_count
from corpuskit.operators import batch, evaluate, sample, setops
from corpuskit.operators.ordering import with_position
from corpuskit.operators.profile import split_stats_of
from corpuskit.operators.project import (
    add_missing,
    align_names,
    binarize,
    drop_null_text,
    drop_unlabelled,
    keep_only,
    plain_condition,
    row_count,
    seed_keep,
    segment,
    total,
)
from corpuskit.operators.score import logits_to_probs, score
from corpuskit.operators.weak import describe_labels, weak_label
from corpuskit.schema import FRACTIONAL_TO_LABEL, IDENTITIES, LABELS, TEXT_COL
from corpuskit.session import freeze, scratch_path

BIAS_LABELS = ["toxicity", "severe_toxicity", "obscene", "threat", "insult", "identity_attack"]


def consolidate_toxic(train: DataFrame, test_texts: DataFrame, test_labels: DataFrame) -> DataFrame:
    """Train rows plus the labelled test rows, with label count and length."""
    test = setops.join_on_id(test_texts, drop_unlabelled(test_labels))
    rows = setops.union_same(train, test.select(*train.columns))
    rows = row_count(rows, LABELS, "label_count")
    return rows.withColumn("comment_length", word_count(F.col("comment_text")))


def consolidate_bias(
    train: DataFrame, plain_n: int = 100_000, seed: int = 42, identities=IDENTITIES, strict: bool = True
) -> DataFrame:
    """Binarised bias corpus: all toxic and identity rows and a draw of the plain ones.

    As in the source, the label count leaves out ``severe_toxicity`` and is only
    filled for toxic rows; the identity count is missing on plain rows.
    """
    rows = align_names(drop_null_text(train), {"target": "toxicity"})
    rows = rows.select("id", "comment_text", *BIAS_LABELS, *identities)
    rows = binarize(rows, BIAS_LABELS + identities).withColumn("__segment", segment(BIAS_LABELS, identities))
    plain = F.col("__segment") == "plain"
    if strict and rows.where(plain).count() < plain_n:
        raise ValueError(f"fewer than {plain_n} plain rows")
    draw = {"plain": sample.Draw(plain, sample.draw_key("id", seed), plain_n)}
    rows = rows.where(~plain | sample.take_first(rows, draw))
    counted = [c for c in BIAS_LABELS if c != "severe_toxicity"]
    return rows.withColumns(
        {
            "label_count": F.when(F.col("__segment") == "toxic", total(counted)),
            "category_count": F.when(~plain, total(identities)),
            "comment_length": word_count(F.col("comment_text")),
        }
    ).drop("__segment")


def integrate(toxic: DataFrame, bias: DataFrame, identities=IDENTITIES) -> DataFrame:
    """Both corpora under one vocabulary; each text once, the toxic corpus first.

    Deduplicating the bias corpus beforehand would not change the result, so the
    texts are shuffled once.
    """
    left = add_missing(toxic, identities + ["category_count"]).withColumn("__source", F.lit(0))
    right = align_names(bias, FRACTIONAL_TO_LABEL).withColumn("__source", F.lit(1))
    rows = setops.dedup_first(setops.union_missing(left, right), "comment_text", ["__source", "id"])
    rows = row_count(rows.drop("__source"), LABELS, "label_count")
    return row_count(rows, identities, "category_count")


def sample_corpus(
    df: DataFrame,
    n_plain: int = 32_000,
    n_identity: int = 8_000,
    rules: list[sample.QuotaRule] = sample.QUOTA_PROGRAMME,
    seed: int = 42,
    identities=IDENTITIES,
    strict: bool = True,
) -> DataFrame:
    """Quota-sampled toxic rows, short plain rows and identity-rich clean rows.

    The sample is frozen: it is small next to the corpus, and later stages must
    not carry the long draw conditions in their plans.
    """
    toxic, identity = F.col("label_count") > 0, F.col("category_count") > 0
    kept = sample.apply_quota_rules(seed_keep(df).withColumn("keep", F.when(toxic, F.col("keep")).otherwise(0)), rules, seed)
    eligible = ~toxic & ~identity & plain_condition()
    draws = {"plain": sample.Draw(eligible, sample.draw_key("id", seed), n_plain)}
    histogram = sample.key_histogram(df, draws)
    if strict and histogram["plain"].sum() < n_plain:
        raise ValueError(f"fewer than {n_plain} eligible plain rows")
    plain = sample.chosen(draws, sample.key_cutoffs(df, draws, histogram))
    clean = sample.take_first(df, sample.identity_draws(df, identities, n_identity, "id", ~toxic & identity))
    # one filter over one scan; three unioned branches would scan the corpus three times
    return freeze(kept.where((toxic & (F.col("keep") == 1)) | plain | clean).drop("keep"))


def flag_corpus_split(df: DataFrame, test_size: float = 0.1, seed: int = 42) -> DataFrame:
    return sample.flag_split(df, test_size=test_size, seed=seed)


def split_corpus(df: DataFrame, test_size: float = 0.1, seed: int = 42):
    """(train, test, statistics of the whole and both sides)."""
    flagged = flag_corpus_split(df, test_size, seed)
    train, test = (flagged.where(F.col("is_test") == side).drop("is_test") for side in (0, 1))
    return train, test, split_stats_of(flagged)


def prepare_for_translation(df: DataFrame, **options) -> DataFrame:
    return clean_for_translation(df, "comment_text", **options)


def translate_new(
    source: DataFrame,
    existing: DataFrame,
    fn: Callable[[str], str],
    prompt: str,
    batch_size: int = batch.DEFAULT_BATCH_SIZE,
    max_batches: int | None = None,
    order_by: list[str] = ["id"],
    parallelism: int | None = None,
    log: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(existing plus new translations, batch report).

    All new rows are translated unless the caller sets ``max_batches``.  Responses go to the append-only
    table ``log``: give a path that outlives the job, and a job that is started again asks the slow external
    function only for what is missing.  Without one the log is a scratch table, which still spares the
    answers of finished tasks when others are repeated.  Parsed rows are frozen, since the merge and the report both read them.
    """
    todo = setops.not_in_source(source.select("id", "comment_text", *_extra(order_by)), existing)
    batched = batch.assign_batches(todo, order_by, batch_size, max_batches)
    requests = batch.format_requests(batched, prompt)
    responses = batch.apply_resumable(requests, fn, log or scratch_path(source.sparkSession, "responses"), parallelism)
    parsed = freeze(batch.parse_responses(responses))
    merged = setops.upsert(existing, parsed.select(F.col("id"), "translated"))
    return merged, batch.translation_report(batched, parsed)


def _extra(order_by):
    return [c for c in order_by if c not in ("id", "comment_text")]


def finalize_translated(translated: DataFrame, source: DataFrame) -> DataFrame:
    """The clean translated corpus, each text once."""
    rows = drop_null_text(setops.in_source(translated, source), "translated")
    rows = setops.dedup_first(rows, "translated", ["id"])
    rows = setops.join_on_id(rows, source)
    return rows.withColumns({c: scrub_pii(F.col(c)) for c in ("translated", "comment_text")})


def balance_translated(
    translated: DataFrame, source: DataFrame, seed: int = 42, identities=IDENTITIES
) -> tuple[DataFrame, DataFrame]:
    """(clean translated corpus, its binary balanced version).

    Balancing reads the table several times, so dedup, join and scrubbing are frozen first.
    """
    rows = freeze(finalize_translated(translated, source))
    balanced = sample.balance_binary(
        rows, "toxic", seed=seed, identity_categories=identities, identity_fraction=0.5
    )
    return rows, balanced


def combine_native(scraped: DataFrame, published: DataFrame, order_by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(mostly toxic comments with new ids, clean comments that keep their source position).

    ``published`` holds ``text`` and ``toxic``; both tables carry the order columns.
    """
    published = align_names(published, {"text": "comment"})
    first = scraped.select("comment", *order_by, F.lit(0).alias("__source"))
    second = published.where("toxic = 1").select("comment", *order_by, F.lit(1).alias("__source"))
    both = with_position(setops.union_same(first, second), ["__source", *order_by], "id")
    placed = with_position(published, order_by, "id")
    return both.select("id", "comment"), placed.where("toxic = 0").select("id", "comment", "toxic")


def label_native(comments: DataFrame, lexicon=UKRAINIAN) -> tuple[DataFrame, DataFrame]:
    labelled = weak_label(comments, lexicon)
    return labelled, describe_labels(labelled)


# --- Fixed values: rows of the translated set that join the test set ----------
TEST_SET_PICKS = [
    (50, "insult", 1),
    (100, "obscene", 1),
    (100, "identity_hate", 1),
    (50, "severe_toxic", 1),
    (120, "threat", 1),
    (200, "toxic", 0),
]
# ------------------------------------------------------------------------------


def build_test_set(
    native: DataFrame,
    translated: DataFrame,
    balanced: DataFrame,
    picks: list[tuple[int, str, int]] = TEST_SET_PICKS,
    order_by: list[str] = ["id"],
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(test set, translated rest, balanced rest): no id is on both sides."""
    narrow = align_names(translated.drop("comment_text", "comment"), {"translated": TEXT_COL})
    narrow = keep_only(narrow, ["id", TEXT_COL, *LABELS, *order_by])
    flagged = sample.select_n(narrow, picks, order_by)
    selected = flagged.where("keep = 1").select("id", TEXT_COL, *LABELS)
    test = setops.union_missing(native, selected)
    rest, rest_balanced = setops.remove_holdout(test, None, [translated, balanced])
    return test, rest, rest_balanced


def normalize_for_model(df: DataFrame, kind: str = "native") -> DataFrame:
    """Model-ready text: ``translated`` tables are also reduced to id, text and labels."""
    if kind == "translated":
        cleaned = clean_for_model(df.drop(TEXT_COL), "translated")
        return keep_only(align_names(cleaned, {"translated": TEXT_COL}), ["id", TEXT_COL, *LABELS])
    if kind == "native":
        return clean_for_model(df, TEXT_COL)
    raise ValueError(f"Invalid data kind: {kind}")


def evaluate_model(
    df: DataFrame, load_model, thresholds=0.5, labels: list[str] = LABELS, text: str = TEXT_COL
) -> tuple[DataFrame, DataFrame]:
    """(one row of metrics, tuned thresholds) of a model on a labelled table.

    The scored table is frozen so that the model runs once for all metrics.
    """
    truth = df.select(text, *[F.col(c).alias(f"y_{c}") for c in labels])
    scored = logits_to_probs(score(truth, load_model, text, labels, clean=False), labels, digits=None)
    scored = freeze(scored.select(*[f"{k}_{c}" for c in labels for k in ("p", "y")]))
    return evaluate.evaluate(scored, labels, thresholds), evaluate.optimize_thresholds(scored, labels)
