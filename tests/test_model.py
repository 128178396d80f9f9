import hashlib
import itertools
import json
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuskit.operators import batch, evaluate, ordering, score, train
from corpuskit.plans import catalog, jobs
from corpuskit.plans import fixtures as fx
from corpuskit.schema import LABELS
from corpuskit.session import freeze, scratch_path
from corpuskit.sources import tables
from corpuskit.streaming import scoring

TWO = ["toxic", "insult"]


def frame(spark, p, y):
    rows = [tuple(float(v) for v in a) + tuple(int(v) for v in b) for a, b in zip(p, y)]
    kinds = ", ".join([f"p_{c} double" for c in TWO] + [f"y_{c} int" for c in TWO])
    return spark.createDataFrame(rows, kinds)


def brute_auc(p, y):
    pos, neg = p[y == 1], p[y == 0]
    return np.mean([(a > b) + (a == b) / 2 for a, b in itertools.product(pos, neg)])


def brute_ap(p, y):
    total, before, area = y.sum(), 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        hit = p >= t
        recall = y[hit].sum() / total
        area += (recall - before) * y[hit].mean()
        before = recall
    return area


def test_ranking_metrics_equal_brute_force_with_ties(spark):
    rng = np.random.default_rng(5)
    p = np.round(rng.random((200, 2)), 1)
    p[:70, 0] = 0.3  # a third of the rows share one score
    y = (rng.random((200, 2)) < 0.4).astype(int)
    got = {r["label"]: r for r in evaluate.ranking_metrics(frame(spark, p, y), TWO).collect()}
    for i, c in enumerate(TWO):
        assert got[c]["roc_auc"] == pytest.approx(brute_auc(p[:, i], y[:, i]))
        assert got[c]["pr_auc"] == pytest.approx(brute_ap(p[:, i], y[:, i]))


def test_auc_of_mirrored_logits(spark, small):
    rows = fx.scores(spark, small)
    ahead = rows.select(*[F.col(f"z_{c}").alias(f"p_{c}") for c in LABELS], *[f"y_{c}" for c in LABELS])
    back = rows.select(*[(-F.col(f"z_{c}")).alias(f"p_{c}") for c in LABELS], *[f"y_{c}" for c in LABELS])
    a = {r["label"]: r["roc_auc"] for r in evaluate.roc_auc(ahead).collect()}
    b = {r["label"]: r["roc_auc"] for r in evaluate.roc_auc(back).collect()}
    assert all(a[c] + b[c] == pytest.approx(1) for c in LABELS)


def test_undefined_and_edge_metrics(spark):
    p = np.array([[0.5, 0.2], [0.4999, 0.9], [0.1, 0.9]])
    y = np.array([[1, 0], [0, 0], [0, 0]])
    df = frame(spark, p, y)
    row = evaluate.evaluate(df, TWO).first()
    assert row["toxic_f1"] == 1 and row["insult_f1"] == 0 and row["insult_roc_auc"] is None
    assert row["toxic_roc_auc"] == 1 and row["hamming_loss"] == pytest.approx(2 / 6)
    assert evaluate.evaluate(df, TWO, zero_all_on_undefined=True).first()["toxic_roc_auc"] == 0
    best = {r["label"]: r for r in evaluate.optimize_thresholds(df, TWO).collect()}
    assert best["insult"]["threshold"] == evaluate.SWEEP[0] and best["insult"]["best_f1"] == 0
    assert max(r["f1"] for r in evaluate.per_label_f1(df, TWO).collect()) >= row["macro_f1"]
    with pytest.raises(ValueError):
        evaluate.load_eval_table(spark, "other", {"native": "/x"})


def test_bce_is_stable(spark):
    df = spark.createDataFrame([(1000.0, 1), (-1000.0, 0), (0.0, 1)], "z_toxic double, y_toxic int")
    assert train.bce_loss(df, ["toxic"]).first()[0] == pytest.approx(np.log(2) / 3)
    assert train.bce_loss(df, ["toxic"], {"toxic": 3.0}).first()[0] == pytest.approx(np.log(2))


def test_probabilities_verdict_and_names(spark):
    z = [-2.0, 3.0, 0.0, -9.0, -9.0, 0.40546]
    df = spark.createDataFrame([tuple(z)], ", ".join(f"z_{c} double" for c in LABELS))
    rows = score.logits_to_probs(df)
    assert [rows.first()[f"p_{c}"] for c in LABELS] == [round(1 / (1 + np.exp(-v)), 4) for v in z]
    line = score.verdict(score.apply_thresholds(rows)).first()["verdict"]
    assert line.endswith("categories:\n  🔸 SEVERE TOXIC\n  🔸 IDENTITY HATE")
    assert score.verdict(score.apply_thresholds(rows, 1.1)).first()["verdict"] == score.VERDICT_CLEAN
    only = score.apply_thresholds(rows, {**{c: 1.1 for c in LABELS}, "toxic": 0.0})
    assert score.verdict(only).first()["verdict"] == score.VERDICT_TOXIC
    assert score.label_map(rows, "p_", "m").first()["m"]["severe_toxic"] == 0.9526
    with pytest.raises(ValueError):
        score.label_name(F.lit("toxic"), "ua")


RESPONSES = [
    (0, '[{"id": 1, "translated": "a \\"b\\"\\nc"}, {"id": "2"}, {"id": " 3 ", "translated": ""}]'),
    (1, '```json\n[{"id":"4","translated":"x"}]\n```'),
    (2, '{"id":"5","translated":"x"}'),
    (3, "[{id: 6, translated: 'broken one'}, {id: '7', translated: \"two\"}"),
    (4, "no answer"),
    (5, None),
    (6, '[{"id":" b\\n","translated":"y"},"junk",3,null,[1]]'),
]


def test_parse_responses(spark):
    df = spark.createDataFrame(RESPONSES, "batch_id long, response string")
    got = sorted((r["batch_id"], r["id"], r["translated"]) for r in batch.parse_responses(df).collect())
    assert got == [(0, "1", "a 'b' c"), (0, "3", ""), (1, "4", "x"), (3, "6", "broken one"), (3, "7", "two"), (6, "b", "y")]


def test_fallback_equals_python_regex(spark, small):
    import re

    pattern = re.compile(batch.FALLBACK, re.I | re.S)
    responses = catalog._responses(catalog._batched_docs(spark, small), malformed=True)
    want = []
    for r in responses.collect():
        for m in pattern.finditer(r["response"].strip()):
            want.append((r["batch_id"], m[1], re.sub(r"\s+", " ", m[2].strip().replace('"', "'")).strip()))
    got = [(r["batch_id"], r["id"], r["translated"]) for r in batch.parse_responses(responses).collect()]
    assert want and sorted(got) == sorted(want)


def test_translation_job_with_a_failing_batch(spark):
    source = spark.createDataFrame([(f"{i:03}", f"text {i}") for i in range(45)], "id string, comment_text string")
    existing = spark.createDataFrame([("000", "done"), ("999", "old")], "id string, translated string")

    def service(request):
        if "text 25'" in request:
            raise TimeoutError("slow")
        return catalog.upper_service(request.replace("text 3'", "TEXT 3'"))

    merged, report = jobs.translate_new(source, existing, service, fx.PROMPT, 10)
    table = {r["id"]: r["translated"] for r in merged.collect()}
    assert table["000"] == "done" and table["999"] == "old" and table["044"] == "text 44" and len(table) == 2 + 34
    lost = {r["batch_id"]: (r["requested"], r["parsed"], r["missing"], r["none_parsed"]) for r in report.collect()}
    assert lost[2] == (10, 0, 10, 1) and lost[4] == (4, 4, 0, 0)
    again, _ = jobs.translate_new(source, merged, service, fx.PROMPT, 10, 1)
    assert again.count() == 2 + 34
    with pytest.raises(ValueError):
        batch.assign_batches(source, ["id"], 51)


def _counting(folder, poison=None, answer=catalog.upper_service):
    """A service that notes every call, and kills its worker once for the request with ``poison``."""

    def service(request):
        name = hashlib.md5(request.encode()).hexdigest()
        with open(os.path.join(folder, name), "a") as file:
            file.write("x")
        marker = os.path.join(folder, "died")
        if poison and poison in request and not os.path.exists(marker):
            open(marker, "w").close()
            os._exit(3)
        return answer(request)

    return service


def _calls(folder):
    return {f: os.path.getsize(os.path.join(folder, f)) for f in os.listdir(folder) if f != "died"}


def test_calls_resume_after_a_lost_task(spark, tmp_path):
    requests = spark.createDataFrame([(i, f"id: {i}, text: 'text {i}'") for i in range(24)], "batch_id long, request string")
    log = scratch_path(spark, "log")
    service = _counting(str(tmp_path), "text 13'", str.upper)
    with pytest.raises(Exception):  # a local master does not repeat failed tasks, so the job ends
        batch.apply_resumable(requests, service, log, parallelism=2, batches_per_task=1)
    answered = {r["digest"] for r in spark.read.parquet(log).collect()} if tables.path_exists(spark, log) else set()
    done = {hashlib.md5(r["request"].encode()).hexdigest() for r in requests.collect() if hashlib.sha256(r["request"].encode()).hexdigest() in answered}
    got = batch.apply_resumable(requests, service, log, parallelism=2, batches_per_task=1)
    assert got.where("response IS NOT NULL").count() == 24
    calls = _calls(str(tmp_path))
    assert len(calls) == 24 and all(calls[name] == 1 for name in done), "answers in the log are not asked for again"
    batch.apply_resumable(requests, service, log)
    assert _calls(str(tmp_path)) == calls, "a third run asks nothing"


def test_translation_job_with_a_log(spark, tmp_path):
    source = spark.createDataFrame([(f"{i:03}", f"text {i}") for i in range(60)], "id string, comment_text string")
    existing = spark.createDataFrame([("000", "done")], "id string, translated string")
    log, service = scratch_path(spark, "log"), _counting(str(tmp_path))
    for _ in range(2):
        merged, report = jobs.translate_new(source, existing, service, fx.PROMPT, 5, log=log)
        assert merged.count() == 60 and report.where("missing > 0").count() == 0
        assert list(_calls(str(tmp_path)).values()) == [1] * 12


def test_errors_are_asked_again_and_answers_are_not(spark, tmp_path):
    requests = spark.createDataFrame([(i, f"r{min(i, 5)}") for i in range(7)], "batch_id long, request string")
    log = scratch_path(spark, "log")
    flaky = tmp_path / "flaky"

    def service(request):
        with open(tmp_path / request, "a") as file:
            file.write("x")
        if request in ("r1", "r5") and not flaky.exists():
            raise TimeoutError("slow")
        return request.upper()

    first = {r["batch_id"]: (r["response"], r["error"]) for r in batch.apply_resumable(requests, service, log, 2, 1).collect()}
    assert first[0] == ("R0", None) and first[1] == (None, "TimeoutError: slow") == first[5] == first[6]
    flaky.touch()
    second = batch.apply_resumable(requests, service, log, batches_per_task=2)
    assert second.columns == ["batch_id", "request", "response", "error"]
    assert {r["batch_id"]: r["response"] for r in second.collect()} == {i: f"R{min(i, 5)}" for i in range(7)}
    assert {f"r{i}": os.path.getsize(tmp_path / f"r{i}") for i in range(6)} == {"r0": 1, "r1": 2, "r2": 1, "r3": 1, "r4": 1, "r5": 2}
    assert batch.apply_resumable(requests.limit(0), service, log).count() == 0


def test_numbering_moves_no_text(spark, monkeypatch):
    frozen = []
    monkeypatch.setattr(ordering, "freeze", lambda df: frozen.append(df) or freeze(df))
    rows = [(i, (i * 7) % 5, f"text {i}", "x") for i in range(100)]
    df = spark.createDataFrame(rows, "id long, rank int, comment_text string, own string").repartition(4)
    got = batch.assign_batches(df, ["rank"], 10)
    assert len(frozen) == 1 and "comment_text" not in frozen[0].columns
    assert [r["id"] for r in got.orderBy("position").collect()] == [r[0] for r in sorted(rows, key=lambda r: (r[1], r[0]))]
    assert got.columns == [*df.columns, "position", "batch_id"]
    first = batch.assign_batches(df, ["rank"], 10, 2)
    assert sorted({r["batch_id"] for r in first.collect()}) == [0, 1] and first.count() == 20


def test_apply_batches_keeps_errors(spark):
    df = spark.createDataFrame([(0, "x"), (1, "y")], "batch_id long, request string")

    def service(request):
        return json.dumps([]) if request == "x" else 1 / 0

    got = {r["batch_id"]: (r["response"], r["error"]) for r in batch.apply_batches(df, service).collect()}
    assert got[0] == ("[]", None) and got[1][0] is None and got[1][1].startswith("ZeroDivisionError")


def test_apply_batches_answers_slice_by_slice(spark, monkeypatch):
    rows = [(i, None if i == 5 else f"r{i}", i * 2) for i in range(40)]
    df = spark.createDataFrame(rows, "batch_id long, request string, n_rows long").coalesce(1)
    got = {r["batch_id"]: r for r in batch.apply_batches(df, lambda request: request + "!").collect()}
    assert len(got) == 40 and got[39].response == "r39!" and got[39].n_rows == 78
    assert got[5].response is None and got[5].error.startswith("TypeError")
    taken = []
    calls = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, fn, kind: taken.append(fn) or self)
    batch.apply_batches(df, lambda request: calls.append(request) or request)
    table = pa.RecordBatch.from_pydict({"request": [r[1] or "" for r in rows]})
    first = next(taken[0](iter([table])))
    assert first.num_rows == len(calls) == batch.SLICE


def test_training_shuffles_one_array_per_core(spark, monkeypatch):
    seen = []
    add_up = train._add_up
    monkeypatch.setattr(train, "_add_up", lambda parts, *rest: seen.append(parts.rdd.getNumPartitions()) or add_up(parts, *rest))
    df = spark.createDataFrame(_word_rows(200), "comment string, toxic int, insult int, threat int")
    cores = spark.sparkContext.defaultParallelism
    many = train.fit_multilabel(df.repartition(3 * cores), TWO, features=64)
    assert seen and max(seen) <= cores
    few = train.fit_multilabel(df.coalesce(1), TWO, features=64)
    assert all(np.allclose(many.weights[c], few.weights[c], atol=1e-6) for c in TWO)


def test_scoring_and_stream_agree(spark, small):
    docs = fx.documents(spark, small).select(F.col("doc_id").alias("id"), F.col("text").alias("comment"))
    folder = scratch_path(spark, "arriving")
    docs.repartition(3).write.parquet(folder)
    stream = scoring.read_stream(spark, folder, docs.schema, 1)
    out = scratch_path(spark, "out")
    scoring.run_available(scoring.score_stream(stream, catalog.word_model), out, scratch_path(spark, "state"))
    want = {r["id"]: r["verdict"] for r in score.verdict(score.apply_thresholds(score.logits_to_probs(
        score.score(docs, catalog.word_model)))).collect()}
    assert {r["id"]: r["verdict"] for r in spark.read.parquet(out).collect()} == want and len(want) > 100


def test_fit_multilabel_learns_and_handles_constant_labels(spark):
    rows = [(f"{'bad word' if i % 3 == 0 else 'good day'} {i % 7}", int(i % 3 == 0), 0) for i in range(120)]
    df = spark.createDataFrame(rows, "comment string, toxic int, insult int")
    out = train.fit_multilabel(df, TWO, iterations=5, features=256).logits(df)
    wrong = out.where((F.col("z_toxic") > 0) != (F.col("toxic") == 1)).count()
    assert wrong == 0 and out.where("z_insult > 0").count() == 0


def _word_rows(n):
    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for _ in range(n):
        own = [words[i] for i in rng.integers(0, 60, rng.integers(0, 25))]
        rows.append((" ".join(own), int("w1" in own or rng.random() < 0.1), int("w2" in own and "w3" not in own), int(rng.random() < 0.3)))
    return rows


def test_joint_training_equals_separate_fits(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors, VectorUDT
    from pyspark.sql.types import DoubleType, StructField, StructType

    labels, features = ["toxic", "insult", "threat"], 128
    df = spark.createDataFrame(_word_rows(600), "comment string, toxic int, insult int, threat int").repartition(5)
    model = train.fit_multilabel(df, labels, features=features, tolerance=1e-9)
    rows = df.select(train.token_indices("comment", features).alias("t"), *labels).collect()
    counts = np.zeros((len(rows), features))
    for i, r in enumerate(rows):
        np.add.at(counts[i], r["t"], 1)
    spread = counts.std(0)
    assert np.allclose(model.scale, np.where(spread > 0, 1 / np.where(spread > 0, spread, 1), 0))
    x, separate = counts * model.scale, 0
    for label in labels:
        y = np.array([r[label] for r in rows], float)
        weight = np.where(y == 1, (len(y) - y.sum()) / (y.sum() + 1e-5), 1.0)

        def objective(point):
            z = x @ point[:-1] + point[-1]
            return (weight * (np.logaddexp(0, z) - y * z)).sum() / weight.sum() + 0.005 * point[:-1] @ point[:-1]

        kind = StructType([StructField("x", VectorUDT()), StructField("y", DoubleType()), StructField("w", DoubleType())])
        table = spark.createDataFrame([(Vectors.dense(a), float(b), float(c)) for a, b, c in zip(x, y, weight)], kind)
        fit = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=0.01, standardization=False, tol=1e-9).fit(table)
        separate += fit.summary.totalIterations
        assert objective(model.weights[label]) <= objective(np.append(fit.coefficients.toArray(), fit.intercept)) + 1e-6
    assert model.passes < separate / 2, "labels share their passes"
    plain = dict(zip([tuple(r["t"]) for r in rows], x @ model.weights["insult"][:-1] + model.weights["insult"][-1]))
    tokens = model.logits(df).select(train.token_indices("comment", features).alias("t"), "z_insult").collect()
    assert np.allclose([r["z_insult"] for r in tokens], [plain[tuple(r["t"])] for r in tokens])


def test_training_defines_odd_input(spark):
    kind = "comment string, toxic int, insult int, z string, z_toxic double"
    rows = [(None, 1, None, "x", 9.0), ("", 0, 0, "x", 9.0), ("a b", 1, 1, "x", 9.0), ("a b", 1, 1, "x", 9.0), ("c", 0, 0, "x", 9.0)]
    df = spark.createDataFrame(rows, kind)
    out = train.fit_multilabel(df, TWO, features=64).logits(df)
    assert out.columns == ["comment", "toxic", "insult", "z", "z_toxic", "z_insult"]
    assert all(np.isfinite(r["z_toxic"]) and r["z"] == "x" for r in out.collect())
    none = train.fit_multilabel(df.limit(0), TWO, features=64).logits(df).collect()
    assert [r["z_toxic"] for r in none] == [-30.0] * 5


def test_model_input_is_shuffled_and_truncated(spark):
    df = spark.createDataFrame([(i, "w " * 200, *([i % 2] * 6)) for i in range(50)], "id int, comment string, " + ", ".join(f"{c} int" for c in LABELS))
    assert all(len(r["tokens"]) == 200 for r in score.build_model_input(df).collect())
    rows = score.build_model_input(df, max_length=128).collect()
    assert all(len(r["tokens"]) == 128 and r["labels"] == [float(r["id"] % 2)] * 6 for r in rows)
    assert [r["id"] for r in rows] != list(range(50))


def test_jobs_reject_unknown_kinds(spark):
    with pytest.raises(ValueError):
        jobs.normalize_for_model(spark.range(1), "other")
