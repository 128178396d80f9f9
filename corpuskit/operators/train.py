"""Training a multi-label classifier: logistic regressions that share every pass over the data.

Each label has its own quasi-Newton state and line search, but a pass computes the losses and
gradients of all labels at once, so training takes as many passes as the slowest label and not
their sum.  The driver holds weights (features x labels), never rows.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.operators.ordering import free_name
from corpuskit.operators.profile import class_weights
from corpuskit.schema import LABELS, TEXT_COL
from corpuskit.session import freeze

HISTORY = 8  # pairs of steps and gradient changes a label remembers
BLOCKS = 32  # parts in which gradients are summed
GROUPS = 32  # more tasks than this are summed in two steps
CONSTANT = 30.0  # the logit of a label that never varied in training


def token_indices(text: str, features: int) -> Column:
    """Feature numbers of the tokens of a text, one per token."""
    tokens = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"(?U)\s+")
    return F.transform(F.filter(tokens, lambda t: t != ""), lambda t: F.pmod(F.hash(t), F.lit(features)))


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All feature numbers, and the row of each."""
    lengths = np.diff(lists.offsets.to_numpy())
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(lists)), lengths)


def _logits(index: np.ndarray, row: np.ndarray, rows: int, weights: np.ndarray) -> np.ndarray:
    """Rows x labels; the last row of ``weights`` holds the intercepts."""
    out = np.empty((rows, weights.shape[1]))
    for label in range(weights.shape[1]):
        out[:, label] = np.bincount(row, weights[index, label], rows) + weights[-1, label]
    return out


class MultiLabelModel:
    """Scales of the features, and weights (features + intercept) of every label."""

    def __init__(self, text: str, features: int, scale: np.ndarray, weights: dict[str, np.ndarray], passes: int):
        self.text, self.features, self.scale, self.weights, self.passes = text, features, scale, weights, passes

    def logits(self, df: DataFrame) -> DataFrame:
        """Add ``z_<label>`` columns; a null text has no tokens."""
        names = list(self.weights)
        scale = np.append(self.scale, 1.0)
        shared = df.sparkSession.sparkContext.broadcast(np.stack([self.weights[n] * scale for n in names], 1))

        @F.pandas_udf("array<double>")
        def score(tokens: pd.Series) -> pd.Series:
            index, row = _flat(pa.array(tokens, pa.list_(pa.int32())))
            return pd.Series(list(_logits(index, row, len(tokens), shared.value)))

        z = free_name(df, "z")
        scored = df.withColumn(z, score(token_indices(self.text, self.features)))
        kept = [F.col(f"`{c}`") for c in df.columns if c not in {f"z_{n}" for n in names}]
        return scored.select(*kept, *[F.col(z)[i].alias(f"z_{n}") for i, n in enumerate(names)])


class Descent:
    """L-BFGS with a backtracking line search, fed with one loss and gradient at a time."""

    def __init__(self, size: int, tolerance: float, iterations: int):
        self.point, self.tolerance, self.left = np.zeros(size), tolerance, iterations
        self.trial, self.loss, self.gradient = self.point, np.inf, None
        self.steps: list[np.ndarray] = []
        self.changes: list[np.ndarray] = []
        self.done = False

    def tell(self, loss: float, gradient: np.ndarray) -> None:
        """The loss and gradient at ``trial``; sets the next trial, or ``done``."""
        if self.gradient is not None and not loss <= self.loss + 1e-4 * self.size * self.slope:
            self.size /= 2
            if self.size < 1e-10:
                self.done = True
            self.trial = self.point + self.size * self.direction
            return
        gain = (self.loss - loss) / max(abs(self.loss), abs(loss), 1e-6) if self.gradient is not None else np.inf
        if self.gradient is not None:
            step, change = self.trial - self.point, gradient - self.gradient
            if step @ change > 1e-12 * (change @ change):
                self.steps, self.changes = [*self.steps, step][-HISTORY:], [*self.changes, change][-HISTORY:]
        self.point, self.loss, self.gradient = self.trial, loss, gradient
        self.left -= 1
        if self.left < 0 or gain <= self.tolerance or np.abs(gradient).max() <= 1e-9:
            self.done = True
            return
        self.direction = -self._scaled(gradient)
        self.slope = gradient @ self.direction
        self.size = 1.0 if self.steps else min(1.0, 1.0 / np.linalg.norm(gradient))
        self.trial = self.point + self.size * self.direction

    def _scaled(self, gradient: np.ndarray) -> np.ndarray:
        """The gradient times the inverse Hessian that steps and changes suggest."""
        q, shares = gradient.copy(), []
        for step, change in zip(reversed(self.steps), reversed(self.changes)):
            share = (step @ q) / (step @ change)
            shares.append(share)
            q -= share * change
        if self.steps:
            q *= (self.steps[-1] @ self.changes[-1]) / (self.changes[-1] @ self.changes[-1])
        for step, change, share in zip(self.steps, self.changes, reversed(shares)):
            q += (share - (change @ q) / (step @ change)) * step
        return q


def _sums(parts: Iterator[np.ndarray]) -> np.ndarray:
    total = None
    for part in parts:
        total = part if total is None else total + part
    return total


def _add_up(parts: DataFrame, tasks: int) -> dict[int, np.ndarray]:
    """Element sums of the arrays of each block, of many tasks first within groups of them."""

    def add(table: pa.Table) -> pa.Table:
        total = _sums(np.frombuffer(v.as_py(), "<f8") for v in table.column("values"))
        return pa.table({"block": table.column("block").slice(0, 1), "values": pa.array([total.tobytes()], pa.binary())})

    kind = "block int, values binary"
    if tasks > GROUPS:
        parts = parts.withColumn("group", F.spark_partition_id() % GROUPS).groupBy("block", "group").applyInArrow(lambda t: add(t), kind)
    summed = parts.groupBy("block").applyInArrow(lambda t: add(t), kind)
    return {r["block"]: np.frombuffer(bytes(r["values"]), "<f8") for r in summed.collect()}


def _blocks(values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A long array in ``BLOCKS`` parts."""
    for block, part in enumerate(np.array_split(values, BLOCKS)):
        yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "values": pa.array([part.astype("<f8").tobytes()], pa.binary())})


def _summed(rows: DataFrame, size: int, add: Callable) -> np.ndarray:
    """The sum over all tasks of an array of ``size`` that ``add(total, batch)`` fills.

    Every task shuffles a whole array, so there is one task per core, however many partitions the rows have.
    """
    tasks = rows.sparkSession.sparkContext.defaultParallelism

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                add(total, batch.slice(start, 1000))
        yield from _blocks(total)

    found = _add_up(rows.coalesce(tasks).mapInArrow(run, "block int, values binary"), tasks)
    return np.concatenate([found[b] for b in range(BLOCKS)])


def fit_multilabel(
    df: DataFrame,
    labels: list[str] = LABELS,
    text: str = TEXT_COL,
    weighted: bool = True,
    features: int = 1 << 18,
    iterations: int = 100,
    tolerance: float = 1e-4,
    regularization: float = 1e-2,
) -> MultiLabelModel:
    """Distributed binary relevance; positives weigh negatives/positives when ``weighted``.

    Minimises per label the weighted mean of the log loss plus ``regularization / 2`` times the squared weights
    (not the intercept), over hashed token counts divided by their standard deviation (which any weight of the
    feature, such as its inverse document frequency, would cancel against).  A label's training stops when the objective changes by less than ``tolerance``; ``iterations`` is a safety net.  A label that
    never varies gets a constant.  Null texts have no tokens; null labels are negatives.
    """
    picked = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"y{i}") for i, c in enumerate(labels)]
    rows = freeze(df.select(token_indices(text, features).alias("tokens"), *picked))
    ys = [f"y{i}" for i in range(len(labels))]
    stats = {r["label"]: r for r in class_weights(rows, ys).collect()}
    size = rows.count()

    def moments(total, batch):
        index, row = _flat(batch.column(0))
        cells, counts = np.unique(row * features + index, return_counts=True)
        for place, power in enumerate((1, 2)):
            total[place * features : (place + 1) * features] += np.bincount(cells % features, counts.astype(float) ** power, features)

    scale = np.zeros(features)
    if size:
        first, second = _summed(rows, 2 * features, moments).reshape(2, features) / size
        spread = np.sqrt(np.maximum(second - first**2, 0))
        scale[spread > 1e-9] = 1 / spread[spread > 1e-9]
    varied = [i for i, y in enumerate(ys) if size and stats[y]["positive"] and stats[y]["negative"]]
    positive = {i: float(stats[ys[i]]["weight"]) if weighted else 1.0 for i in varied}
    mass = {i: positive[i] * float(stats[ys[i]]["positive"]) + float(stats[ys[i]]["negative"]) for i in varied}
    descents = {i: Descent(features + 1, tolerance, iterations) for i in varied}
    passes = 0
    context = df.sparkSession.sparkContext
    while active := [i for i, d in descents.items() if not d.done]:
        passes += 1
        shared = context.broadcast((scale, np.stack([descents[i].trial for i in active], 1)))

        def evaluate(total, batch, shared=shared, active=active):
            scale, weights = shared.value
            index, row = _flat(batch.column(0))
            scaled = weights * np.append(scale, 1.0)[:, None]
            z = _logits(index, row, batch.num_rows, scaled)
            view = total.reshape(len(active), features + 2)  # loss, gradient, gradient of the intercept
            for place, label in enumerate(active):
                y = batch.column(1 + label).to_numpy()
                weight = np.where(y == 1, positive[label], 1.0)
                own = z[:, place]
                view[place, 0] += (weight * (np.logaddexp(0, own) - y * own)).sum()
                pull = weight * (0.5 * (1 + np.tanh(own / 2)) - y)
                view[place, 1:-1] += np.bincount(index, pull[row], features) * scale
                view[place, -1] += pull.sum()

        found = _summed(rows, len(active) * (features + 2), evaluate).reshape(len(active), features + 2)
        shared.unpersist()
        for place, label in enumerate(active):
            trial = descents[label].trial
            loss = found[place, 0] / mass[label] + regularization / 2 * float(trial[:-1] @ trial[:-1])
            gradient = found[place, 1:] / mass[label]
            gradient[:-1] += regularization * trial[:-1]
            descents[label].tell(loss, gradient)
    weights = {}
    for i, label in enumerate(labels):
        weights[label] = descents[i].point if i in descents else np.zeros(features + 1)
        if i not in descents:
            weights[label][-1] = CONSTANT if size and stats[ys[i]]["positive"] else -CONSTANT
    return MultiLabelModel(text, features, scale, weights, passes)


def bce_loss(
    df: DataFrame, labels: list[str] = LABELS, weights: dict[str, float] | None = None
) -> DataFrame:
    """Binary cross-entropy over all N x L cells; positives are weighted by ``weights``."""
    def softplus(x):
        return F.log1p(F.exp(-F.abs(x))) + F.greatest(x, F.lit(0.0))

    cells = F.lit(0.0)
    for c in labels:
        z, y = F.col(f"z_{c}").cast("double"), F.col(f"y_{c}")
        w = F.lit(float((weights or {}).get(c, 1.0)))
        cells = cells + w * y * softplus(-z) + (1 - y) * softplus(z)
    return df.agg((F.avg(cells) / len(labels)).alias("loss"))
