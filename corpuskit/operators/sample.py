"""Quota sampling, stratified splits and class balancing.

Every draw is reproducible from ``seed`` and the id column, whatever the
partitioning.  Ids must be unique.  Draws are filters on cut-off keys (see
``ordering``): the driver sees one value per draw and no row is moved.
"""

from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.operators.ordering import (
    Draw,
    chosen,
    draw_key,
    draw_rank,
    free_name,
    key_cutoffs,
    key_histogram,
    order_token,
    smallest,
    take_first,
)
from corpuskit.operators.project import stratum
from corpuskit.schema import IDENTITIES, LABELS
from corpuskit.session import freeze


def sample_n(df: DataFrame, n: int, seed: int = 42, row_id: str = "id", strict: bool = True) -> DataFrame:
    """Exactly ``n`` rows without replacement; asking for more than there are is an error."""
    draws = {"all": Draw(F.lit(True), draw_key(row_id, seed), n)}
    histogram = key_histogram(df, draws)
    if strict and histogram["all"].sum() < n:
        raise ValueError(f"cannot draw {n} rows without replacement from a smaller table")
    return df.where(chosen(draws, key_cutoffs(df, draws, histogram)))


def shuffle(df: DataFrame, seed: int = 42, row_id: str = "id") -> DataFrame:
    return df.orderBy(draw_key(row_id, seed), row_id)


def shuffle_positions(df: DataFrame, seed: int = 42, row_id: str = "id", out: str = "position") -> DataFrame:
    """Zero-based place of each row in the shuffled order, for order that must outlive a write."""
    ranked = draw_rank(df, row_id, seed, out=out)
    return ranked.withColumn(out, F.col(out) - 1)


def peek(df: DataFrame, n: int = 10, seed: int = 0, row_id: str = "id") -> DataFrame:
    return sample_n(df, n, seed, row_id, strict=False)


def identity_draws(df, categories, n, row_id, rule, max_words=400) -> dict[str, Draw]:
    """Per identity: short rows under ``rule``, fewest identities first, then by id."""
    token = order_token(df, ["category_count", row_id])
    short = F.col("comment_length") <= max_words
    share = n // len(categories)
    return {c: Draw(rule & (F.col(c) == 1) & short, token, share) for c in categories}


def select_by_identity(
    df: DataFrame, categories: list[str] = IDENTITIES, n: int = 8000, row_id: str = "id", max_words: int = 400
) -> DataFrame:
    """Per identity, the short rows with the fewest identities first, then by id.

    A row may be picked for several identities, so the result can hold fewer than ``n`` rows.
    """
    return df.where(take_first(df, identity_draws(df, categories, n, row_id, F.lit(True), max_words)))


class QuotaRule(NamedTuple):
    """Add up to ``n`` rows of ``category`` with ``label_count`` labels and few identities."""

    category: str
    n: int
    max_identities: int = 2
    label_count: int = 2


# --- Fixed values: the quota programme ----------------------------------------
_FIRST_SET = ["white", "black", "muslim", "male", "female", "christian", "homosexual_gay_or_lesbian"]
_SECOND_SET = ["jewish", "psychiatric_or_mental_illness"]
QUOTA_PROGRAMME = (
    [
        QuotaRule("obscene", 1600, 0),
        QuotaRule("insult", 800, 0),
        QuotaRule("identity_hate", 2000, 0, 1),
        QuotaRule("identity_hate", 2500, 0),
        QuotaRule("obscene", 1300, 0, 3),
        QuotaRule("insult", 800, 0, 3),
        QuotaRule("identity_hate", 2500, 0, 3),
    ]
    + [QuotaRule(c, n, 2, k) for c in _FIRST_SET for n, k in ((200, 1), (100, 2), (100, 3))]
    + [QuotaRule(c, n, 2, k) for c in _SECOND_SET for n, k in ((500, 1), (300, 2), (300, 3))]
    + [QuotaRule("identity_hate", 200, k, 2) for k in (1, 2, 3)]
    + [
        QuotaRule(c, n, k, 3)
        for c in _SECOND_SET + _FIRST_SET[5:]
        for n, k in ((200, 1), (100, 2))
    ]
)
# ------------------------------------------------------------------------------


def _candidate(rule: QuotaRule) -> Column:
    return (
        (F.col(rule.category) == 1)
        & (F.col("label_count") == rule.label_count)
        & (F.col("category_count") <= rule.max_identities)
    )


def add_category_samples(df: DataFrame, rule: QuotaRule, seed: int = 42, row_id: str = "id") -> DataFrame:
    """Set ``keep`` on up to ``rule.n`` random candidates that are not kept yet."""
    draw = Draw(_candidate(rule) & (F.col("keep") == 0), draw_key(row_id, seed), rule.n)
    taken = take_first(df, {"rule": draw})
    return df.withColumn("keep", F.when(taken, 1).otherwise(F.col("keep")))


def apply_quota_rules(
    df: DataFrame, rules: list[QuotaRule] = QUOTA_PROGRAMME, seed: int = 42, row_id: str = "id"
) -> DataFrame:
    """Run the rules in order; each sees the rows that earlier rules kept.

    Rules for different label counts never compete for a row, so they form independent chains.  The
    rows a rule takes are among its ``n`` + (all earlier quotas of its chain) smallest draw keys, since
    earlier rules can take no more than their quotas.  One scan counts keys per rule and prefix, which
    bounds those keys; a second gathers them; the chains are then resolved on that
    table, whose size depends on the quotas and not on the data.  The ids taken (at most the sum of all quotas)
    are broadcast back to ``df``.
    """
    need, before = {}, {}
    for number, rule in enumerate(rules):
        need[number] = before.get(rule.label_count, 0) + rule.n
        before[rule.label_count] = need[number]
    rules = dict(enumerate(rules))
    wanted = {n: r for n, r in rules.items() if r.n > 0}
    if not wanted:
        return df.withColumn("keep", F.when(F.col("keep") == 1, 1).otherwise(0))
    matching = F.array_compact(F.array(*[F.when(_candidate(r), F.lit(n)) for n, r in wanted.items()]))
    picks = df.where("keep = 0").select(F.col(row_id).alias("id"), F.explode(matching).alias("rule"))
    picks = picks.withColumn("token", draw_key("id", F.concat(F.lit(f"{seed}-"), "rule")))
    near = freeze(smallest(picks, "rule", {n: need[n] for n in wanted}))
    chain = F.create_map(*[F.lit(x) for n, r in wanted.items() for x in (n, r.label_count)])[F.col("rule")]
    quota = {n: r.n for n, r in wanted.items()}

    def resolve(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("rule", "token", "id"))), key=lambda r: r[:2])
        taken, left = set(), dict(quota)
        for number, _, own in rows:
            if left[number] and own not in taken:
                taken.add(own)
                left[number] -= 1
        return pa.table({"id": pa.array(list(taken), table.schema.field("id").type)})

    kind = near.select("id").schema
    taken = freeze(near.withColumn("chain", chain).groupBy("chain").applyInArrow(lambda t: resolve(t), kind).distinct())
    own, mark = free_name(df, "own"), free_name(df, "mark")
    marked = F.broadcast(taken.select(F.col("id").alias(own), F.lit(1).alias(mark)))
    joined = df.join(marked, F.col(row_id).eqNullSafe(F.col(own)), "left")
    keep = F.when((F.col("keep") == 1) | (F.col(mark) == 1), 1).otherwise(0)
    return joined.select(*[keep.alias(c) if c == "keep" else F.col(f"`{c}`") for c in df.columns])


def select_n(
    df: DataFrame, picks: list[tuple[int, str, int]], order_by: list[str], out: str = "keep"
) -> DataFrame:
    """Flag the first ``n`` rows with ``column = value`` for every (n, column, value).

    A pick does not skip rows that another pick flags, so all picks are one pass.
    """
    token = order_token(df, order_by)
    draws = {
        f"{i}:{column}={value}": Draw(F.col(column) == value, token, n)
        for i, (n, column, value) in enumerate(picks)
    }
    return df.withColumn(out, F.when(take_first(df, draws), 1).otherwise(0))


def split_quotas(counts: dict[str, int], test_size: float) -> dict[str, int]:
    """Rows per stratum for the test side: truncated shares, the rest to the complement."""
    toxic = counts["toxic_identity"] + counts["toxic_plain"]
    clean = counts["clean_identity"] + counts["clean_plain"]
    wanted = int((toxic + clean) * test_size)
    toxic_n = int(wanted * (toxic / (toxic + clean))) if toxic + clean else 0
    clean_n = wanted - toxic_n
    toxic_identity = int(toxic_n * (counts["toxic_identity"] / toxic)) if toxic else 0
    clean_identity = int(clean_n * (counts["clean_identity"] / clean)) if clean else 0
    quotas = {
        "toxic_identity": toxic_identity,
        "toxic_plain": toxic_n - toxic_identity,
        "clean_identity": clean_identity,
        "clean_plain": clean_n - clean_identity,
    }
    return {name: min(n, counts[name]) for name, n in quotas.items()}


def flag_split(
    df: DataFrame,
    toxicity: list[str] = LABELS,
    identities: list[str] = IDENTITIES,
    test_size: float = 0.2,
    seed: int = 42,
    row_id: str = "id",
) -> DataFrame:
    """Add ``is_test`` so that toxic and identity ratios are those of the whole table."""
    name = stratum(toxicity, identities)
    strata = ["toxic_identity", "toxic_plain", "clean_identity", "clean_plain"]
    token = draw_key(row_id, seed)
    draws = {s: Draw(name == s, token, 0) for s in strata}
    histogram = key_histogram(df, draws)
    quotas = split_quotas({s: int(n.sum()) for s, n in histogram.items()}, test_size)
    draws = {s: draw._replace(n=quotas[s]) for s, draw in draws.items()}
    return df.withColumn("is_test", F.when(chosen(draws, key_cutoffs(df, draws, histogram)), 1).otherwise(0))


def rule_based_split(df: DataFrame, shuffled: bool = False, **options) -> tuple[DataFrame, DataFrame]:
    """(train, test) by the stratified split, each in seeded random order if ``shuffled``."""
    flagged = flag_split(df, **options)
    sides = [flagged.where(f"is_test = {side}").drop("is_test") for side in (0, 1)]
    if shuffled:
        sides = [shuffle(rows, options.get("seed", 42), options.get("row_id", "id")) for rows in sides]
    return sides[0], sides[1]


def balance_binary(
    df: DataFrame,
    label: str = "toxic",
    method: str = "downsample",
    seed: int = 42,
    identity_categories: list[str] | None = None,
    identity_fraction: float = 0.25,
    row_id: str = "id",
    top_up: bool = False,
    shuffled: bool = False,
) -> DataFrame:
    """Equal numbers of positive and negative rows, in seeded random order if ``shuffled``.

    ``downsample`` draws min(positive, negative) of each class; with identity
    categories a share of the negatives is picked by identity first and, as a row
    can serve several identities, the result may hold fewer negatives unless
    ``top_up`` fills the gap.  ``upsample`` draws max(positive, negative) of both
    classes with replacement and numbers the draws in ``slot``.
    """
    if method not in ("downsample", "upsample"):
        raise ValueError(f"Unknown method: {method}")
    positive, negative = F.col(label) > 0, F.col(label) == 0
    key = draw_key(row_id, seed)
    draws = {"pos": Draw(positive, key, 0), "neg": Draw(negative, key, 0)}
    histogram = key_histogram(df, draws)
    size = {side: int(counts.sum()) for side, counts in histogram.items()}
    if method == "upsample":
        balanced = _bootstrap(df, positive, negative, size, seed, row_id)
        return balanced.orderBy(draw_key(F.concat_ws(":", row_id, "slot"), seed), row_id, "slot") if shuffled else balanced
    n = min(size["pos"], size["neg"])
    taken, random_n = F.lit(False), n
    if identity_categories:
        wanted = int(n * identity_fraction)
        taken = take_first(df, identity_draws(df, identity_categories, wanted, row_id, negative))
        draws["neg"] = Draw(negative & ~taken, key, 0)
        histogram |= key_histogram(df, {"neg": draws["neg"]})
        picked = size["neg"] - int(histogram["neg"].sum())
        random_n = n - (picked if top_up else wanted)
    draws = {"pos": draws["pos"]._replace(n=n), "neg": draws["neg"]._replace(n=random_n)}
    balanced = df.where(taken | chosen(draws, key_cutoffs(df, draws, histogram)))
    return shuffle(balanced, seed, row_id) if shuffled else balanced


def _bootstrap(df, positive, negative, size, seed, row_id) -> DataFrame:
    """Exact-size draw with replacement: each slot hashes to a rank of its class."""
    spark = df.sparkSession
    n = max(size["pos"], size["neg"])
    side = "__side"
    rows = df.where(positive | negative).withColumn(side, F.when(positive, "pos").otherwise("neg"))
    ranked = draw_rank(rows, row_id, seed, by=[side], out="__rank")
    slots = None
    for name in ("pos", "neg"):
        if not size[name]:
            continue
        hashed = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(name), F.col("slot"))), 1, 15)
        pick = F.conv(hashed, 16, 10).cast("long") % F.lit(size[name]) + 1
        part = spark.range(n).withColumnRenamed("id", "slot")
        part = part.select(F.lit(name).alias(side), "slot", pick.alias("__rank"))
        slots = part if slots is None else slots.unionByName(part)
    if slots is None:
        return df.limit(0).withColumn("slot", F.lit(0).cast("long"))
    return slots.join(ranked, [side, "__rank"]).select(*df.columns, "slot")
