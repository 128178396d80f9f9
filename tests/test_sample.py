import hashlib

import pytest
from pyspark.sql import functions as F

from corpuskit.operators import ordering, project, sample
from corpuskit.plans import fixtures as fx
from corpuskit.schema import IDENTITIES, LABELS
from corpuskit.session import freeze


def key(i, seed=42):
    return hashlib.md5(f"{seed}:{i}".encode()).hexdigest()


@pytest.fixture(scope="module")
def rows(spark, small):
    return freeze(fx.comments(spark, small).drop("comment_text"))


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_draws_do_not_depend_on_partitions(spark):
    df = spark.range(5000)
    want = sorted(sorted(range(5000), key=key)[:1700])
    for parts in (1, 7, 64):
        assert ids(sample.sample_n(df.repartition(parts), 1700)) == want
    assert ids(sample.sample_n(df, 900)) == sorted(sorted(range(5000), key=key)[:900])
    with pytest.raises(ValueError):
        sample.sample_n(df, 5001)
    assert len(ids(sample.peek(df, 9999))) == 5000


def test_cutoffs_narrow_large_groups_exactly(spark):
    df = spark.range(-3000, 7000).withColumn("hot", F.when(F.col("id") % 3 == 0, 1).otherwise(0))
    token = ordering.order_token(df, ["id"])
    draws = {"all": ordering.Draw(F.lit(True), token, 4321), "hot": ordering.Draw(F.col("hot") == 1, token, 1200),
             "whole": ordering.Draw(F.col("hot") == 0, token, 10**6), "none": ordering.Draw(F.lit(True), token, 0)}
    last = ordering.cutoffs(df, draws)
    took = {n: ids(df.where(ordering.chosen({n: d}, last))) for n, d in draws.items()}
    assert took["all"] == list(range(-3000, 1321))
    assert took["hot"] == [i for i in range(-3000, 7000) if i % 3 == 0][:1200]
    assert len(took["whole"]) == df.where("hot = 0").count() and took["none"] == []


def test_cutoffs_with_string_order_and_ties(spark):
    names = sorted(f"user{i}" for i in range(3000))
    df = spark.createDataFrame([(n, i % 4) for i, n in enumerate(names)], "id string, c int")
    token = ordering.order_token(df, ["c", "id"])
    got = ids(df.where(ordering.take_first(df, {"x": ordering.Draw(F.lit(True), token, 1501)})))
    order = sorted(((i % 4, n) for i, n in enumerate(names)))[:1501]
    assert got == sorted(n for _, n in order)


def test_rank_and_position(spark):
    df = spark.range(3000).withColumn("g", F.col("id") % 2)
    got = {r["id"]: r["rank"] for r in ordering.draw_rank(df, "id", 42, ["g"]).collect()}
    for g in (0, 1):
        order = sorted(range(g, 3000, 2), key=key)
        assert [got[i] for i in order] == list(range(1, 1501))
    placed = ordering.with_position(df.repartition(13), [F.desc("id")], "pos", 5)
    assert all(r["pos"] == 2999 - r["id"] + 5 for r in placed.collect())


def test_running_sums_of_signed_values(spark):
    values = [-1e9, -2.5, -2.4999, -1e-9, 0.0, 1e-12, 0.5, 0.5001, 1.0, 3e8]
    df = spark.createDataFrame([("a", v, i + 1) for i, v in enumerate(values)], "g string, v double, n long")
    up = {r["v"]: r["upto_n"] for r in ordering.running_sums(df, ["g"], "v", ["n"]).collect()}
    down = {r["v"]: r["upto_n"] for r in ordering.running_sums(df, ["g"], "v", ["n"], True).collect()}
    for i, v in enumerate(values):
        assert up[v] == sum(range(1, i + 2)) and down[v] == sum(range(i + 1, 11))


def test_split(rows):
    flagged = sample.flag_split(rows)
    train, test = sample.rule_based_split(rows)
    counts = rows.groupBy(project.stratum().alias("s")).count()
    counts = {s: 0 for s in ("toxic_identity", "toxic_plain", "clean_identity", "clean_plain")} | {
        r["s"]: r["count"] for r in counts.collect()}
    quotas = sample.split_quotas(counts, 0.2)
    assert flagged.where("is_test = 1").count() == test.count() == sum(quotas.values())
    assert ids(train) == sorted(set(ids(rows)) - set(ids(test)))
    assert ids(sample.rule_based_split(rows.repartition(9))[1]) == ids(test)


def test_split_quotas_truncate_and_survive_empty_groups():
    assert sample.split_quotas({"toxic_identity": 0, "toxic_plain": 0, "clean_identity": 3, "clean_plain": 7}, 0.5) == {
        "toxic_identity": 0, "toxic_plain": 0, "clean_identity": 1, "clean_plain": 4}


def test_balance(rows):
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    down = sample.balance_binary(rows)
    assert {r["toxic"]: r["count"] for r in down.groupBy("toxic").count().collect()} == dict.fromkeys((0, 1), min(sizes.values()))
    up = sample.balance_binary(rows, method="upsample")
    assert {r["toxic"]: r["count"] for r in up.groupBy("toxic").count().collect()} == dict.fromkeys((0, 1), max(sizes.values()))
    aware = sample.balance_binary(rows, identity_categories=IDENTITIES, identity_fraction=0.5)
    topped = sample.balance_binary(rows, identity_categories=IDENTITIES, identity_fraction=0.5, top_up=True)
    assert aware.where("toxic = 0").count() <= min(sizes.values()) == topped.where("toxic = 0").count()
    with pytest.raises(ValueError):
        sample.balance_binary(rows, method="smote")


def test_quota_rules_equal_rule_by_rule(rows):
    rules = [sample.QuotaRule("insult", 5, 1, 2), sample.QuotaRule("obscene", 6, 2, 2), sample.QuotaRule("toxic", 4, 2, 1),
             sample.QuotaRule("insult", 3, 2, 2)]
    table = {r["id"]: r.asDict() for r in project.seed_keep(rows).collect()}
    for number, rule in enumerate(rules):
        open_ids = [i for i, r in table.items() if r[rule.category] == 1 and r["keep"] == 0
                    and r["label_count"] == rule.label_count and r["category_count"] <= rule.max_identities]
        for i in sorted(open_ids, key=lambda i: key(i, f"42-{number}"))[: rule.n]:
            table[i]["keep"] = 1
    got = sample.apply_quota_rules(project.seed_keep(rows), rules)
    assert {r["id"]: r["keep"] for r in got.collect()} == {i: r["keep"] for i, r in table.items()}
    assert len(sample.QUOTA_PROGRAMME) == 45


def test_draw_is_a_filter_without_shuffle(spark):
    plan = sample.sample_n(spark.range(1000), 10)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_draws_leave_nothing_cached(spark):
    df = spark.range(4000).withColumn("hot", F.when(F.col("id") % 3 == 0, 1).otherwise(0))
    draws = {c: ordering.Draw(F.col("hot") == v, sample.draw_key("id", 1), 500) for c, v in (("a", 0), ("b", 1))}
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    assert df.where(ordering.take_first(df, draws)).count() == 1000
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_running_sums_spread_close_values(spark):
    """Saturated scores: many distinct values in a tiny interval are still dealt out evenly."""
    df = spark.range(200_000).select(F.lit("g").alias("g"), (1 - F.col("id") * 1e-9).alias("v"), F.lit(1).alias("n"))
    out = ordering.running_sums(df, ["g"], "v", ["n"])
    assert out.where("upto_n != round((v - (1 - 199999e-9)) / 1e-9) + 1").count() == 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # the data would fit one partition
    try:
        parts = ordering.freeze(df.orderBy("g", "v")).groupBy(F.spark_partition_id().alias("p")).count()
        sizes = [r["count"] for r in parts.collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) < 4 * 200_000 / len(sizes)


def scans(spark, df, action):
    """How often ``action`` reads the rows of ``df`` before its result is read."""
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    result = action(df.mapInArrow(count, df.schema))
    return result, read.value / df.count()


def test_draws_scan_twice(spark, rows):
    rows = freeze(rows.repartition(3))
    plain = sample.sample_n(rows, 77)
    for action, same in (
        (lambda df: sample.sample_n(df, 77), lambda got: ids(got) == ids(plain)),
        (lambda df: sample.flag_split(df), lambda got: got.where("is_test = 1").count() > 0),
        (lambda df: sample.balance_binary(df), lambda got: got.count() > 0),
        (lambda df: sample.apply_quota_rules(project.seed_keep(df)), lambda got: got.where("keep = 1").count() > 0),
    ):
        got, number = scans(spark, rows, action)
        assert number <= 2 and same(got)


def test_key_cutoffs_at_every_size(spark):
    """Whole groups, empty groups, ends inside and at the end of a prefix, repeated ids."""
    df = spark.range(3000).union(spark.range(50)).withColumn("g", F.col("id") % 3)
    draws = {str(g): ordering.Draw(F.col("g") == g, ordering.draw_key("id", 7), 0) for g in range(4)}
    histogram = ordering.key_histogram(df, draws)
    order = {g: sorted([i for i in [*range(3000), *range(50)] if i % 3 == g], key=lambda i: key(i, 7)) for g in range(3)}
    for n in (0, 1, 2, 333, 999, 1017, 5000):
        last = ordering.key_cutoffs(df, {k: d._replace(n=n) for k, d in draws.items()}, histogram)
        for g in range(3):
            got = ids(df.where(ordering.chosen({str(g): draws[str(g)]}, last)))
            ends = order[g][: n] and order[g][min(n, len(order[g])) - 1]
            want = [i for i in order[g] if n and key(i, 7) <= key(ends, 7)]
            assert got == sorted(want), (n, g)
        assert last["3"] is None


def test_quota_programme_on_a_view_with_hot_rules(spark):
    """All 45 rules over an unfrozen view, a third of the rows in one rule, null and repeated ids, clashing names."""
    base = spark.range(6000).select(
        F.when(F.col("id") == 17, None).when(F.col("id") == 18, 19).otherwise(F.col("id")).alias("id"),
        *[(F.pmod(F.xxhash64("id", F.lit(c)), F.lit(5)) == 0).cast("int").alias(c) for c in LABELS + IDENTITIES],
    )
    hot = F.col("id") % 3 == 0
    view = base.withColumns({"insult": F.when(hot, 1).otherwise(F.col("insult")), "obscene": F.when(hot, 1).otherwise(F.col("obscene"))})
    view = view.withColumns({
        "label_count": F.when(hot, 2).otherwise(sum(F.col(c) for c in LABELS)),
        "category_count": F.when(hot, 0).otherwise(sum(F.col(c) for c in IDENTITIES)),
        "keep": (F.pmod(F.xxhash64("id"), F.lit(50)) == 0).cast("int"), "own": F.lit("x"), "token": F.lit("y"), "rule": F.lit("z"),
    })
    rules = [r._replace(n=max(1, r.n // 20)) for r in sample.QUOTA_PROGRAMME]
    table = [r.asDict() for r in view.collect()]
    kept = {r["id"] for r in table if r["keep"] == 1}
    for number, rule in enumerate(rules):
        found = {r["id"] for r in table if r["keep"] == 0 and r["id"] not in kept and r[rule.category] == 1
                 and r["label_count"] == rule.label_count and r["category_count"] <= rule.max_identities}
        name = lambda i: hashlib.md5((f"42-{number}" if i is None else f"42-{number}:{i}").encode()).hexdigest()
        kept |= set(sorted(found, key=name)[: rule.n])
    got = sample.apply_quota_rules(view, rules)
    assert got.columns == view.columns
    assert {r["id"] for r in got.where("keep = 1").collect()} == kept
    assert got.count() == 6000


def test_balance_in_seeded_order(spark):
    df = spark.range(500).withColumn("toxic", (F.col("id") % 4 == 0).cast("int"))
    got = [r["id"] for r in sample.balance_binary(df, shuffled=True).collect()]
    assert got == sorted(got, key=key) != sorted(got) and len(got) == 250
    up = sample.balance_binary(df, method="upsample", shuffled=True)
    first, second = up.collect(), sample.balance_binary(df.repartition(5), method="upsample", shuffled=True).collect()
    assert len(first) == 750 and first == second and [r["id"] for r in first] != sorted(r["id"] for r in first)
