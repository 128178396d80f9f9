import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuskit.operators import profile, project, setops
from corpuskit.schema import LABELS, TOXIC_TEXTS
from corpuskit.session import scratch_path
from corpuskit.sources import tables


def test_csv_roundtrip_keeps_lines_and_quotes(spark):
    rows = [("1", 'a "b"\nc, d'), ("2", "x\\y"), ("3", "")]
    path = scratch_path(spark, "t") + ".csv"
    tables.write_table(spark.createDataFrame(rows, TOXIC_TEXTS), path)
    back = {r["id"]: r["comment_text"] for r in tables.read_comments(spark, path, TOXIC_TEXTS).collect()}
    assert back["1"] == rows[0][1] and back["2"] == rows[1][1]
    with pytest.raises(ValueError):
        tables.read_comments(spark, path)


def test_read_or_empty_and_rewrite(spark):
    path = scratch_path(spark, "stage")
    assert tables.read_or_empty(spark, path, TOXIC_TEXTS).count() == 0
    tables.write_table(spark.range(10), path)
    after = tables.rewrite_stage(spark.read.parquet(path).where("id < 4"), path)
    assert sorted(r["id"] for r in after.collect()) == [0, 1, 2, 3]
    again = tables.rewrite_stage(after.where("id > 1"), path)
    assert sorted(r["id"] for r in again.collect()) == [2, 3]


def whole(spark, path):
    return sorted(r["id"] for r in tables.read_comments(spark, path).collect())


@pytest.mark.parametrize("step", ["_claim", "_mark", "_prune", "write"])
def test_a_killed_rewrite_leaves_a_whole_table(spark, monkeypatch, step):
    path = scratch_path(spark, "stage")
    tables.write_table(spark.range(10), path)
    for known in (list(range(10)), [0, 1, 2, 3]):
        rows = tables.read_comments(spark, path)
        with monkeypatch.context() as patched:
            if step == "write":
                fail = F.udf(lambda i: 1 // (i - 3), "long")
                rows = rows.withColumn("id", fail("id"))  # a task fails while the version is being written
            else:
                def killed(*_):
                    raise KeyboardInterrupt

                patched.setattr(tables, step, killed)
            with pytest.raises((KeyboardInterrupt, Exception)):
                tables.rewrite_stage(rows.where("id < 2"), path)
        # only after the mark is the new version the current one
        assert whole(spark, path) == ([0, 1] if step == "_prune" else known)
        tables.rewrite_stage(spark.range(4), path)
        assert whole(spark, path) == [0, 1, 2, 3]


def test_versions_are_numbered_kept_and_pruned(spark):
    path = scratch_path(spark, "stage")
    tables.write_table(spark.range(3), path)
    first = tables.read_comments(spark, path)
    for n in range(4, 8):
        before = tables.read_comments(spark, path)
        tables.rewrite_stage(before.union(spark.range(n - 1, n)), path)
        assert before.count() == n - 1, "a reader that has begun can go on"
    assert whole(spark, path) == list(range(7)) and len(tables._numbers(spark, path, tables.MARK)) == 2
    assert not tables.path_exists(spark, path) and first.schema.names == ["id"]
    number, other = tables._claim(spark, path), tables._claim(spark, path)
    assert other == number + 1, "two writers never share a version"
    tables.write_table(spark.range(1), path, "overwrite")
    tables.write_table(spark.range(5, 6), path, "append")
    assert whole(spark, path) == [0, 5]
    with pytest.raises(ValueError):
        tables.rewrite_stage(spark.range(1), path, keep=1)


def test_convert_csv(spark, tmp_path):
    rows = [("1", 'a "b"\nc, d'), ("2", "x\\y"), ("3", "z")]
    path = scratch_path(spark, "t") + ".csv"
    tables.write_table(spark.createDataFrame(rows, TOXIC_TEXTS), path)
    table = tables.convert_csv(spark, path, str(tmp_path / "out"), TOXIC_TEXTS)
    assert sorted((r["id"], r["comment_text"]) for r in table.select("id", "comment_text").collect()) == rows
    again = tables.rewrite_stage(tables.read_comments(spark, path, TOXIC_TEXTS).where("id < '3'"), path)
    assert again.count() == tables.read_comments(spark, path, TOXIC_TEXTS).count() == 2


def test_binarize_missing_and_nan(spark):
    df = spark.createDataFrame([(0.5,), (0.49,), (None,), (float("nan"),)], "x double")
    assert [r["x"] for r in project.binarize(df, ["x"]).collect()] == [1, 0, 0, 0]


def test_predicates(spark):
    df = spark.createDataFrame([(1, " \n"), (2, "a"), (3, " ")], "id int, comment_text string")
    assert [r["id"] for r in project.drop_blank(df).collect()] == [2]
    marks = spark.createDataFrame([(1, -1, 0), (2, 0, 1), (3, None, 0)], "id int, toxic int, insult int")
    assert [r["id"] for r in project.drop_unlabelled(marks, ["toxic", "insult"]).collect()] == [2, 3]
    plain = spark.createDataFrame([(1, 5, "Wikipedia"), (2, 5, None), (3, 500, "x")], "id int, comment_length int, comment_text string")
    assert [r["id"] for r in project.plain_filter(plain).collect()] == [2]


def test_dedup_and_upsert(spark):
    rows = [(3, "x"), (1, "x"), (2, None), (5, None), (4, "y")]
    df = spark.createDataFrame(rows, "id int, text string")
    assert sorted(r["id"] for r in setops.dedup_first(df, "text", ["id"]).collect()) == [1, 2, 4]
    new = spark.createDataFrame([(1, "new"), (9, "z"), (9, "z")], "id int, text string")
    got = {r["id"]: r["text"] for r in setops.upsert(df, new).collect()}
    assert got[1] == "x" and got[9] == "z" and len(got) == 6


def test_dedup_prunes_copies_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id", "cast(id % 3 as string) as text")
    plan = setops.dedup_first(df, "text", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_holdout(spark):
    ids = lambda df: sorted(r["id"] for r in df.collect())
    every = spark.range(10)
    rest, other = setops.remove_holdout(spark.range(3), every, [every, spark.range(2, 6)])
    assert ids(rest) == list(range(3, 10)) and ids(other) == [3, 4, 5]


def test_describe_equals_numpy(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(0, 3, 400), np.full(300, 1.25), [1e9, -1e-9]])
    rows = [(int(i % 2), float(v)) for i, v in enumerate(values)] + [(0, None), (1, float("nan"))]
    df = spark.createDataFrame(rows, "g int, v double")
    for r in profile.describe(df, ["v"], ["g"]).collect():
        mine = values[r["g"] :: 2]
        want = [len(mine), mine.mean(), mine.std(ddof=1), mine.min(), *np.quantile(mine, [0.25, 0.5, 0.75]), mine.max()]
        got = [r[c] for c in ("n", "mean", "std", "min", "p25", "p50", "p75", "max")]
        assert np.allclose(got, want, rtol=1e-9)
    assert profile.describe(df, ["v"]).first()["n"] == len(values)


def test_histogram_density_and_empty(spark):
    df = spark.createDataFrame([(v,) for v in [1, 1, 2, 5, 11]], "x int")
    counts = [r["n"] for r in profile.histogram(df, "x", 5).orderBy("bin").collect()]
    assert counts == np.histogram([1, 1, 2, 5, 11], bins=5)[0].tolist()
    curve = [r["density"] for r in profile.density(df, "x", 3).orderBy("grid_point").collect()]
    data = np.array([1, 1, 2, 5, 11.0])
    width = data.std(ddof=1) * 5**-0.2
    want = [np.exp(-0.5 * ((x - data) / width) ** 2).sum() / (5 * width * math.sqrt(2 * math.pi)) for x in (1, 6, 11)]
    assert np.allclose(curve, want)
    assert profile.density(df.limit(0), "x").count() == 0
    assert profile.histogram(df.limit(0), "x").count() == 30


def test_correlation_of_constant_is_null(spark):
    df = spark.createDataFrame([(1, 0, 1), (0, 0, 0), (1, 0, 1)], "a int, b int, c int")
    got = {(r["a"], r["b"]): r["r"] for r in profile.label_correlation(df, ["a", "b", "c"]).collect()}
    assert got[("a", "b")] is None and abs(got[("a", "c")] - 1) < 1e-12


def test_counts_in_one_pass(spark):
    df = spark.createDataFrame([(1, 1, 0, 0, 0, 0), (0, 0, 1, 0, 0, 0), (1, 0, 0, 0, 0, 0)], ", ".join(f"{c} int" for c in LABELS))
    assert profile.inconsistent_count(df).first()[0] == 1
    plan = profile.label_by_identity(df, LABELS[1:3], LABELS)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1
    assert profile.class_weights(df).where("label = 'toxic'").first()["weight"] == pytest.approx(1 / 2.00001)
    assert F is not None
