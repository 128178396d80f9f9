"""Multiprobe neighbours against all pairs: exact scores, order and recall."""

import math

import numpy as np
import pytest

from corpuskit.llm import neighbours as N
from corpuskit.llm.queries import QUERIES


def test_probe_sequence_is_ordered_and_valid():
    m, rows = 5, N.probe_sequence(5, 80)
    assert not rows[0].any() and len({tuple(r) for r in rows}) == 80
    assert all(not (r[s] and r[2 * m - 1 - s]) for r in rows for s in range(2 * m))
    j = np.arange(1, m + 1)
    low = j * (j + 1) / (4 * (m + 1) * (m + 2))
    high = [1 - (2 * m + 1 - i) / (m + 1) + (2 * m + 1 - i) * (2 * m + 2 - i) / (4 * (m + 1) * (m + 2)) for i in range(m + 1, 2 * m + 1)]
    cost = rows.astype(float) @ np.concatenate([low, high])
    assert (np.diff(cost) > -1e-12).all()


def test_probes_are_neighbouring_buckets():
    tables = N.Tables(8, 2, 4, 1.0, 60)
    units = np.random.default_rng(1).standard_normal((5, 8))
    for t in range(2):
        cells, inside = tables.cells(units, t)
        for c, place, probes in zip(cells, inside, tables.probes(units, t)):
            near = {int(tables.keys(c + np.array(d), t)) for d in __import__("itertools").product((-1, 0, 1), repeat=4)}
            assert set(probes.tolist()) <= near and probes[0] == tables.keys(c, t)
            step = min([(w, i, -1) for i, w in enumerate(place)] + [(1 - w, i, 1) for i, w in enumerate(place)])
            moved = c.copy()
            moved[step[1]] += step[2]
            assert probes[1] == tables.keys(moved, t)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.1"])
def test_recall_and_exact_scores(spark, size):
    folder = f"/root/testdata/{size}"
    data = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    ids, x = data.vec_id.to_numpy(), np.array(data.embedding.to_list(), np.float64)
    norms = np.sqrt((x * x).sum(1))
    rows = QUERIES["op3_multiprobe_neighbours"](spark, folder).collect()
    by = {}
    for r in rows:
        by.setdefault(r.query_id, []).append(r)
    queries = [i for i in ids if i % 50 == 0]
    assert set(by) == set(queries)
    hits = 0
    for q in queries:
        own = x[np.flatnonzero(ids == q)[0]]
        cos = dict(zip(ids, (x @ own) / norms / math.sqrt(own @ own)))
        best = sorted((i for i in ids if i != q), key=lambda i: (-cos[i], i))[:5]
        got = sorted(by[q], key=lambda r: r.rank)
        assert [r.rank for r in got] == [1, 2, 3, 4, 5]
        assert [r.score for r in got] == pytest.approx([cos[r.vec_id] for r in got], abs=1e-12)
        assert [(-r.score, r.vec_id) for r in got] == sorted((-r.score, r.vec_id) for r in got)
        hits += len({r.vec_id for r in got} & set(best))
    assert hits >= 0.9 * 5 * len(queries)


@pytest.mark.parametrize("part", [20_000, 7])
def test_odd_rows_ties_and_hot_vectors(spark, part):
    rng = np.random.default_rng(3)
    hot = rng.standard_normal(6).tolist()
    rows = [(i, hot if i % 3 == 0 else rng.standard_normal(6).tolist(), 1, 0.5) for i in range(60)]
    rows += [(100, None, 1, 0.5), (110, [0.0] * 6, 1, 0.5), (120, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1, 0.5), (130, [float("nan")] * 6, 1, 0.5), (140, [float("inf")] + [1.0] * 5, 1, 0.5), (150, [], 1, 0.5), (160, [1.0], 1, 0.5), (None, hot, 1, 0.5), rows[6]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, query int, score double")
    got = N.nearest(df, lambda i: i % 10 == 0, projections=3, width=4.0, probes=27, part_vectors=part).collect()
    valid = {i: np.array(v) for i, v, *_ in rows[:60]}
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert set(by) == {0, 10, 20, 30, 40, 50}
    for q, found in by.items():
        cos = {i: round(float(v @ valid[q] / math.sqrt((v @ v) * (valid[q] @ valid[q]))), 10) for i, v in valid.items() if i != q}
        assert [i for _, i in sorted(found)] == sorted(cos, key=lambda i: (-cos[i], i))[:5]
    few = df.where("vec_id in (0, 1, 2)")
    assert sorted(r.vec_id for r in N.nearest(few, lambda i: i == 0, width=50.0).collect()) == [1, 2]
    assert N.nearest(df.limit(0), lambda i: i == 0).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 6, 50])
def test_small_tables_with_default_parameters(spark, n):
    """All other rows, or k of them, however few the index finds; the completed answers are exact."""
    x = np.random.default_rng(n).standard_normal((n, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    by = {}
    for r in N.nearest(df, lambda i: i % 2 == 0, part_vectors=20).collect():
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(by) == (set(range(0, n, 2)) if n > 1 else set())
    cos = x @ x.T / np.sqrt((x * x).sum(1)[:, None] * (x * x).sum(1)[None])
    for q, found in by.items():
        order = sorted((i for i in range(n) if i != q), key=lambda i: (-cos[q, i], i))
        assert [r for r, _, _ in sorted(found)] == list(range(1, min(5, n - 1) + 1))
        if n <= 6:
            assert [i for _, i, _ in sorted(found)] == order[:5]
        assert [s for _, _, s in sorted(found)] == pytest.approx([cos[q, i] for _, i, _ in sorted(found)], abs=1e-12)


@pytest.mark.parametrize("dimension, clusters", [(64, 0), (384, 0), (768, 0), (64, 40)])
def test_parameters_follow_the_data(spark, dimension, clusters):
    rng = np.random.default_rng(dimension + clusters)
    x = rng.standard_normal((2000, dimension))
    if clusters:
        x = rng.standard_normal((clusters, dimension))[rng.integers(0, clusters, 2000)] + 0.1 * x
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    cos = _cos(x)
    hits = total = 0
    for r in N.nearest(df, lambda i: i % 10 == 0, part_vectors=300).collect():
        total += 1
        hits += r.vec_id in set(np.argsort(-cos[r.query_id])[:5])
    assert total == 1000 and hits >= 0.9 * total


def test_clustered_vectors_compare_few_rows(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((100, 32))[rng.integers(0, 100, 3000)] + 0.05 * rng.standard_normal((3000, 32))
    stored = spark.createDataFrame([(v.tolist(), [i]) for i, v in enumerate(x)], "v array<double>, ids array<long>")
    queries = stored.select(stored["ids"][0].alias("id"), "v").where("id % 20 = 0")
    width, probes = N.fit(stored, queries, 3000, 32, 5, 8, 16, 0.96, None, N.PROBES)
    index = N.Tables(32, 8, 16, width, probes)
    units = x / np.sqrt((x * x).sum(1))[:, None]
    compared = sum(np.isin(index.keys(index.cells(units, t)[0], t), index.probes(units[:1], t)[0]).sum() for t in range(8))
    assert probes < 3000 and compared < 8 * 3000 / 10
    assert N.fit(stored, queries.limit(0), 3000, 32, 5, 8, 16, 0.96, None, N.PROBES)


def _cos(x):
    units = x / np.sqrt((x * x).sum(1))[:, None]
    cos = units @ units.T
    np.fill_diagonal(cos, -2)
    return cos
