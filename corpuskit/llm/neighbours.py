"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled to length one, where the nearest by Euclidean distance are the nearest by
cosine.  Each table hashes a vector by ``projections`` Gaussian projections, shifted and cut into
cells of ``width``.  A query visits its own bucket and perturbed ones in the order of their
estimated success: single steps are sorted by the query's distance to the cell wall, and sets of steps follow a
sequence ranked by the expected squared distances.  Candidates of all tables are
ranked again by their exact cosine.

The width of a cell and the number of probes come from the table itself: the true neighbours of some sampled queries
show how often any choice would meet them, and the cheapest choice that meets enough is taken.

Buckets are grouped into shards, and a shard with many vectors is split by vector, so that a
third of all vectors in one bucket is still spread.  Only the best few of a query leave a shard.
"""

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuskit.llm.common import batch_of, mix
from corpuskit.session import freeze


def probe_sequence(projections: int, probes: int) -> np.ndarray:
    """Sets of steps, best first, as 0/1 rows over the 2 x projections steps sorted by wall distance.

    The j-th smallest of the wall distances has a known expected square; a set costs the sum of its
    squares.  Two steps of one projection (ranks that add up to 2 x projections + 1) exclude
    each other.  The first row is the query's own bucket.
    """
    m = projections
    j = np.arange(1, m + 1)
    low = j * (j + 1) / (4 * (m + 1) * (m + 2))
    high = 1 - (2 * m + 1 - np.arange(m + 1, 2 * m + 1)) / (m + 1) + (2 * m + 1 - np.arange(m + 1, 2 * m + 1)) * (2 * m + 2 - np.arange(m + 1, 2 * m + 1)) / (4 * (m + 1) * (m + 2))
    cost = np.concatenate([low, high])
    rows = [np.zeros(2 * m, np.uint64)]
    heap = [(cost[0], (0,))]
    while heap and len(rows) < probes:
        total, steps = heapq.heappop(heap)
        if all(2 * m - 1 - s not in steps for s in steps):
            row = np.zeros(2 * m, np.uint64)
            row[list(steps)] = 1
            rows.append(row)
        last = steps[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*steps[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*steps, last + 1)))
    return np.array(rows)


class Tables:
    """Random projections of all tables; the same seed gives the same tables everywhere."""

    def __init__(self, dimension: int, tables: int, projections: int, width: float, probes: int, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.directions = rng.standard_normal((tables, dimension, projections))
        self.shifts = rng.uniform(0, width, (tables, projections))
        self.factors = rng.integers(0, 2**63, (tables, projections)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.width, self.sequence = width, probe_sequence(projections, probes)

    def cells(self, units: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Cell numbers, and the distance to the lower wall in cells."""
        place = (units @ self.directions[t] + self.shifts[t]) / self.width
        cell = np.floor(place)
        return cell.astype(np.int64), place - cell

    def keys(self, cells: np.ndarray, t: int) -> np.ndarray:
        """Bucket keys, linear in the cell numbers."""
        return (cells.astype(np.uint64) * self.factors[t]).sum(-1, dtype=np.uint64)

    def probes(self, units: np.ndarray, t: int) -> np.ndarray:
        """Keys of the buckets to visit, one row per query, best first."""
        cells, inside = self.cells(units, t)
        walls = np.concatenate([inside, 1 - inside], 1)  # steps down, then steps up
        change = np.concatenate([np.uint64(0) - self.factors[t], self.factors[t]])
        ranked = change[np.argsort(walls, 1, kind="stable")]
        return self.keys(cells, t)[:, None] + ranked @ self.sequence.T


FIT_QUERIES = 128  # sampled queries whose true neighbours choose the parameters
FIT_ROWS = 2_000  # sampled rows that tell how many a choice would compare
WIDTHS = (1.0, 1.25, 1.6, 2.0, 2.25, 2.5, 2.8, 3.2, 4.0, 6.0, 12.0, 1000.0)  # in distances of a true neighbour
PROBES = (30, 100, 300, 1000, 3000)
PROBE_COST = 2.0  # a visited bucket costs as much as comparing so many rows


def _first_met(probes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """At which probe a query meets each key; the number of probes if at none."""
    order = np.argsort(probes, kind="stable")
    at = np.minimum(np.searchsorted(probes[order], keys), len(probes) - 1)
    return np.where(probes[order][at] == keys, order[at], len(probes))


def _true_neighbours(stored: DataFrame, asked: list, k: int) -> list[np.ndarray]:
    """The ``k`` nearest stored vectors of each asked one, other than equal ones, by comparing with all rows.

    Every task keeps its own best few ids per query; only those of the asked rows reach the driver.
    """
    wanted = np.array([r["v"] for r in asked], np.float64)
    wanted /= np.sqrt((wanted * wanted).sum(1))[:, None]
    schema = pa.schema([("q", pa.int32()), ("first", pa.int64()), ("score", pa.float64())])

    def compare(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            first = np.array([i[0] for i in batch.column("ids").to_pylist()])
            scores = wanted @ _units(batch, "v")[1].T
            few = np.argsort(-scores, 1, kind="stable")[:, : k + 1]
            q = np.repeat(np.arange(len(wanted), dtype=np.int32), few.shape[1])
            yield batch_of(schema, [q, first[few].ravel(), np.take_along_axis(scores, few, 1).ravel()])

    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "first"))
    met = stored.mapInArrow(compare, "q int, first long, score double").withColumn("rank", rank).where(F.col("rank") <= k + 1).collect()
    some = stored.where(F.col("ids")[0].isin([r["first"] for r in met])).collect()
    by_id = {r["ids"][0]: np.array(r["v"], np.float64) for r in some}
    out = []
    for q, own in enumerate(asked):
        own_v = np.array(own["v"], np.float64)
        near = [by_id[r["first"]] for r in sorted(met, key=lambda r: r["rank"]) if r["q"] == q and not (by_id[r["first"]] == own_v).all()]
        out.append(np.array(near[:k]).reshape(-1, wanted.shape[1]))
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(-1, keepdims=True))


def fit(
    stored: DataFrame, queries: DataFrame, rows: int, dimension: int, k: int, tables: int, projections: int, recall: float,
    widths: tuple[float, ...] | None, probes: tuple[int, ...],
) -> tuple[float, int]:
    """The cheapest (width, probes) whose tables meet a share of ``recall`` of the sampled queries' true neighbours.

    ``FIT_QUERIES`` queries are compared with all rows, and ``FIT_ROWS`` rows tell how many a choice compares; both
    are those of the least hashes.  Widths are tried in multiples of the median distance of a true neighbour; the widest holds all rows in
    one bucket, so some choice always does.
    """
    asked = queries.orderBy(F.xxhash64("id"), "id").limit(FIT_QUERIES).collect()
    near = _true_neighbours(stored, asked, k) if asked else []
    own = [i for i, v in enumerate(near) if len(v)]
    if not own:
        return (widths or (1.0,))[0], probes[0]
    units = _unit(np.array([asked[i]["v"] for i in own], np.float64))
    near = [_unit(near[i]) for i in own]
    some = stored.orderBy(F.xxhash64(F.col("ids")[0]), F.col("ids")[0]).limit(FIT_ROWS).collect()
    some = _unit(np.array([r["v"] for r in some], np.float64))
    distance = max(float(np.median(np.concatenate([np.sqrt(((v - u) ** 2).sum(1)) for u, v in zip(units, near)]))), 1e-6)
    steps, best = np.array(probes), None
    for width in widths or [distance * x for x in WIDTHS]:
        index = Tables(dimension, tables, projections, width, max(probes))
        first = [np.full(len(v), max(probes)) for v in near]
        compared = np.zeros(len(steps))
        for t in range(tables):
            others = index.keys(index.cells(some, t)[0], t)
            for i, (wanted, v) in enumerate(zip(index.probes(units, t), near)):
                first[i] = np.minimum(first[i], _first_met(wanted, index.keys(index.cells(v, t)[0], t)))
                compared += (_first_met(wanted, others)[:, None] < np.minimum(steps, len(wanted))).sum(0)
        met = (np.concatenate(first)[:, None] < steps).mean(0)
        cost = compared / len(units) / len(some) * rows + PROBE_COST * tables * steps
        for m, c, n in zip(met, cost, probes):
            choice = (m < recall, c if m >= recall else -m, width, n)
            best = choice if best is None else min(best, choice)
    return best[2], best[3]


def cosines(vectors: np.ndarray, norms: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact cosines; every row is summed alike, so equal vectors have equal scores."""
    return (vectors * query).sum(1) / (norms * math.sqrt((query * query).sum()))


ROWS = "part long, query boolean, id long, ids array<long>, vector binary, keys binary"
_ROWS = pa.schema(
    [("part", pa.int64()), ("query", pa.bool_()), ("id", pa.int64()), ("ids", pa.list_(pa.int64())), ("vector", pa.binary()), ("keys", pa.binary())]
)
FOUND = "query_id long, first long, ids array<long>, score double"
_FOUND = pa.schema([("query_id", pa.int64()), ("first", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])
PART_BYTES = 10 << 20  # of vectors in a part
LARGE = 50_000  # shards of a table that may be split
SPLITS = 1 << 20  # part = (table, shard, split) in one number


def _units(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    vectors = np.array(batch.column(column).to_pylist(), np.float64)
    return vectors, vectors / np.sqrt((vectors * vectors).sum(1))[:, None]


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mix(keys) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)


def _search(batches, k: int) -> Iterator[pa.RecordBatch]:
    """Answer the queries of each part, which follow its vectors."""
    part, held, out = None, [], []
    keys = vectors = norms = ids = None

    def flush():
        return batch_of(_FOUND, list(zip(*out)) or [[]] * 4)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("part", "query", "id", "ids", "vector", "keys")]
        for at, is_query, own, some, vector, key in zip(*columns):
            if at != part:
                part, held, keys = at, [], None
            if not is_query:
                held.append((key, vector, some))
                continue
            if not held:
                continue
            if keys is None:
                held.sort(key=lambda h: np.frombuffer(h[0], "<u8")[0])
                keys = np.frombuffer(b"".join([h[0] for h in held]), "<u8")
                vectors = np.frombuffer(b"".join([h[1] for h in held]), "<f8").reshape(len(held), -1)
                norms, ids = np.sqrt((vectors * vectors).sum(1)), [h[2] for h in held]
            probes = np.frombuffer(key, "<u8")
            low, high = np.searchsorted(keys, probes, "left"), np.searchsorted(keys, probes, "right")
            met = np.flatnonzero(high > low)
            if not len(met):
                continue
            sizes = high[met] - low[met]
            places = np.repeat(low[met] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
            scores = cosines(vectors[places], norms[places], np.frombuffer(vector, "<f8"))
            if len(places) > 4 * k:  # keep ties of the last place
                kept = scores >= np.partition(scores, -k - 1)[-k - 1]
                places, scores = places[kept], scores[kept]
            best = sorted(zip((-scores).tolist(), [ids[p][0] for p in places], places.tolist()))[: k + 1]
            out += [(own, first, ids[p], -score) for score, first, p in best]
            if len(out) > 5000:
                yield flush()
                out = []
    yield flush()


def nearest(
    vectors: DataFrame,
    is_query,
    k: int = 5,
    tables: int = 8,
    projections: int = 16,
    width: float | None = None,
    probes: int | None = None,
    recall: float = 0.96,
    part_vectors: int | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): up to ``k`` nearest other rows of each query found by the index.

    ``is_query`` is a condition on the id column.  Vectors that are null, zero, or hold null or non-finite numbers
    take no part, nor do null ids and vectors of another length than most.  Rows that share an
    id are one row (with the least of their vectors).  Equal vectors are searched once, under
    their ``k + 1`` smallest ids, which is all that a result can name.  Ties go to the smaller id.  Other
    columns are ignored.  A query that meets fewer than ``k`` rows by the index (in small tables) is compared with all
    rows, so it gets ``k`` rows, or all there are.

    Where ``width`` or ``probes`` is not given, ``fit`` chooses it so that a share of ``recall`` of the true neighbours of
    a bounded sample of queries is met, whatever the dimension: directionless random vectors need wide cells and many
    probes, clustered ones few.  A part has ``part_vectors`` vectors, by default those of ``PART_BYTES``.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dimension = common["n"] if common else 1
    rows = rows.where(F.size("v") == dimension).groupBy("id").agg(F.min("v").alias("v"))
    rows = freeze(rows)
    place = F.row_number().over(W.partitionBy("v").orderBy("id"))
    few = rows.withColumn("place", place).where(F.col("place") <= k + 1)
    stored = freeze(few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    part_vectors = part_vectors or max(1, PART_BYTES // (8 * dimension))
    distinct, queries = stored.count(), rows.where(is_query(F.col("id")))
    shards = max(1, math.ceil(distinct / part_vectors))
    if width is None or probes is None:
        tried = None if width is None else (width,), PROBES if probes is None else (probes,)
        width, probes = fit(stored, queries, distinct, dimension, k, tables, projections, recall, *tried)
    index = Tables(dimension, tables, projections, width, probes)  # below 1 MB, travels with the functions

    def count(batches):
        total = np.zeros((tables, shards), np.int64)
        for batch in batches:
            _, units = _units(batch, "v")
            for t in range(tables):
                keys = index.keys(index.cells(units, t)[0], t)
                total[t] += np.bincount(_shard(keys, shards).astype(int), minlength=shards)
        t, s = np.nonzero(total)
        yield batch_of(pa.schema([("t", pa.int32()), ("s", pa.int64()), ("n", pa.int64())]), [t, s, total[t, s]])

    sizes = stored.select("v").mapInArrow(count, "t int, s long, n long").groupBy("t", "s").agg(F.sum("n").alias("n"))
    # only shards of far more than a part reach the driver, at most LARGE of each table, however many rows there are
    above = max(4 * part_vectors, distinct // LARGE)
    large = {(r["t"], r["s"]): math.ceil(r["n"] / part_vectors) for r in sizes.where(F.col("n") > above).collect()}
    splits = spark.sparkContext.broadcast(large)

    def store(batches):
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            raw, units = _units(batch, "v")
            for t in range(tables):
                keys = index.keys(index.cells(units, t)[0], t)
                parts = []
                for s, own in zip(_shard(keys, shards).tolist(), ids):
                    split = int(mix(np.array([own[0]], np.uint64))[0] % splits.value.get((t, s), 1)) if (t, s) in splits.value else 0
                    parts.append((t * shards + s) * SPLITS + split)
                data = [x.tobytes() for x in raw], [x.tobytes() for x in keys.astype("<u8")]
                yield batch_of(_ROWS, [parts, [False] * len(ids), [i[0] for i in ids], ids, *data])

    def ask(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                raw, units = _units(some, "v")
                out = []
                for t in range(tables):
                    wanted = index.probes(units, t) if len(raw) else []
                    for own, vector, keys in zip(some.column("id").to_pylist(), raw, wanted):
                        shard = _shard(keys, shards)
                        order = np.argsort(shard, kind="stable")
                        edges = np.flatnonzero(np.append(True, shard[order][1:] != shard[order][:-1]))
                        for a, b in zip(edges, np.append(edges[1:], len(order))):
                            s = int(shard[order[a]])
                            data = keys[order[a:b]].astype("<u8").tobytes()
                            for split in range(splits.value.get((t, s), 1)):
                                out.append(((t * shards + s) * SPLITS + split, True, own, None, vector.tobytes(), data))
                    yield batch_of(_ROWS, list(zip(*out)) or [[]] * 6)
                    out = []

    by_index = freeze(_ranked(stored.mapInArrow(store, ROWS).unionByName(queries.mapInArrow(ask, ROWS)), k))
    # queries that met too few rows are compared with all rows, part by part
    wanted = min(k, rows.count() - 1)
    enough = by_index.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= wanted)
    short = queries.join(enough.select(F.col("query_id").alias("id")), "id", "left_anti")
    if wanted <= 0 or not short.limit(1).count():
        return by_index
    exact = _ranked(_every_row(stored, shards).unionByName(_every_part(short, shards)), k)
    return by_index.join(enough.select("query_id"), "query_id", "left_semi").unionByName(exact)


def _ranked(asked: DataFrame, k: int) -> DataFrame:
    """The nearest others of each query among the rows that it meets in its parts."""
    spread = asked.repartition(F.col("part")).sortWithinPartitions("part", "query", "id")
    found = spread.mapInArrow(lambda batches: _search(batches, k), FOUND)
    merged = found.groupBy("query_id", "first").agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
    each = merged.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id != query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


ANY = np.zeros(1, "<u8").tobytes()  # one bucket that holds every row of a part


def _every_row(stored: DataFrame, parts: int) -> DataFrame:
    """All vectors, each in one part and in its only bucket."""

    def place(batches):
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            first = [i[0] for i in ids]
            part = (mix(np.array(first, np.int64).astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
            raw, _ = _units(batch, "v") if ids else (np.zeros((0, 1)), None)
            yield batch_of(_ROWS, [part, [False] * len(ids), first, ids, [x.tobytes() for x in raw], [ANY] * len(ids)])

    return stored.mapInArrow(place, ROWS)


def _every_part(queries: DataFrame, parts: int) -> DataFrame:
    """Each query once for every part."""

    def ask(batches):
        for batch in batches:
            own = batch.column("id").to_pylist()
            raw, _ = _units(batch, "v") if own else (np.zeros((0, 1)), None)
            data = [x.tobytes() for x in raw]
            for part in range(parts):
                yield batch_of(_ROWS, [[part] * len(own), [True] * len(own), own, [None] * len(own), data, [ANY] * len(own)])

    return queries.mapInArrow(ask, ROWS)
