"""Reproducible order keys, exact distributed positions and exact "first n" cut-offs.

Seeded draws order rows by ``md5(seed:id)``, which does not depend on how the
data are partitioned.  "First n of a group" is answered with a cut-off: the n-th
smallest key of the group.  A cut-off is found with narrow aggregates and turns
the draw into a plain filter, so the rows themselves are never shuffled or sorted.
"""

import json
from collections.abc import Mapping
from functools import reduce
from operator import and_
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from corpuskit.session import freeze

BUCKET_CHARS = 4  # 65,536 buckets of a hexadecimal key


def draw_key(row_id: str | Column, seed: int | str | Column) -> Column:
    row_id = F.col(row_id) if isinstance(row_id, str) else row_id
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws(":", seed, row_id.cast("string")).cast("binary"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def order_token(df: DataFrame, columns: list[str]) -> Column:
    """A string whose order is that of ``columns``: integers of any size, then one string."""
    parts = []
    for place, name in enumerate(columns):
        kind = df.schema[name].dataType
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            # flipping the sign bit makes the hexadecimal order the numeric order
            unsigned = F.col(name).cast("long").bitwiseXOR(F.lit(-(2**63)))
            parts.append(F.lpad(F.hex(unsigned), 16, "0"))
        elif isinstance(kind, T.StringType) and place == len(columns) - 1:
            parts.append(F.col(name))
        else:
            raise TypeError(f"cannot order by {name}: {kind.simpleString()}")
    return F.concat(*parts)


class Draw(NamedTuple):
    """The ``n`` rows with the smallest ``token`` among the rows where ``rule`` holds."""

    rule: Column
    token: Column
    n: int


def cutoffs(df: DataFrame, draws: Mapping[str, Draw]) -> dict[str, str | None]:
    """Largest token each draw takes; ``None`` where it takes nothing.

    Rows may belong to several draws.  The driver receives a few values per draw.
    """
    wanted = {name: draw for name, draw in draws.items() if draw.n > 0}
    result: dict[str, str | None] = {name: None for name in draws}
    if not wanted:
        return result
    member = [
        F.when(d.rule, F.struct(F.lit(name).alias("draw"), d.token.alias("token")))
        for name, d in wanted.items()
    ]
    keys = df.select(F.explode(F.array_compact(F.array(*member))).alias("m")).select("m.draw", "m.token")
    keys = keys.persist()  # narrow, read once per narrowing step, and given back at the end
    try:
        return result | _search(keys, wanted)
    finally:
        keys.unpersist()


def _search(keys: DataFrame, wanted: Mapping[str, Draw]) -> dict[str, str | None]:
    result: dict[str, str | None] = {}
    span = keys.groupBy("draw").agg(
        F.count("*").alias("rows"), F.min("token").alias("low"), F.max("token").alias("high")
    )
    open_draws = {}  # name -> (common prefix, how many of it are still needed)
    for row in span.collect():
        n = wanted[row["draw"]].n
        if row["rows"] <= n or row["low"] == row["high"]:
            result[row["draw"]] = row["high"]
        else:
            open_draws[row["draw"]] = (_common_prefix(row["low"], row["high"]), n)

    while open_draws:
        for name, state in _narrow(keys, open_draws).items():
            if isinstance(state, str):
                result[name] = state
                del open_draws[name]
            else:
                open_draws[name] = state
    return result


def _common_prefix(low: str, high: str) -> str:
    size = 0
    while size < min(len(low), len(high)) and low[size] == high[size]:
        size += 1
    return low[:size]


def _inside(keys: DataFrame, open_draws: dict) -> DataFrame:
    condition = F.lit(False)
    for name, (prefix, _) in open_draws.items():
        condition = condition | ((F.col("draw") == name) & F.col("token").startswith(prefix))
    return keys.where(condition)


def _narrow(keys: DataFrame, open_draws: dict) -> dict:
    """Count keys per longer prefix and step into the bucket that holds the cut-off."""
    length = F.create_map(
        *[F.lit(x) for k, v in open_draws.items() for x in (k, len(v[0]) + BUCKET_CHARS)]
    )[F.col("draw")]
    need = F.create_map(*[F.lit(x) for k, v in open_draws.items() for x in (k, v[1])])[F.col("draw")]
    buckets = (
        _inside(keys, open_draws)
        .groupBy("draw", F.col("token").substr(F.lit(1), length).alias("bucket"))
        .agg(F.count("*").alias("rows"), F.min("token").alias("low"), F.max("token").alias("high"))
    )
    running = W.partitionBy("draw").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    edge = buckets.withColumn("upto", F.sum("rows").over(running)).where(
        (F.col("upto") >= need) & (F.col("upto") - F.col("rows") < need)
    )
    found = {}
    for row in edge.collect():
        before = row["upto"] - row["rows"]
        rest = open_draws[row["draw"]][1] - before
        if row["low"] == row["high"] or rest == row["rows"]:
            found[row["draw"]] = row["high"]
        else:
            found[row["draw"]] = (_common_prefix(row["low"], row["high"]), rest)
    return found


def chosen(draws: Mapping[str, Draw], last: Mapping[str, str | None]) -> Column:
    """True on the rows that any of the draws takes."""
    taken = F.lit(False)
    for name, draw in draws.items():
        if last[name] is not None:
            taken = taken | F.coalesce(draw.rule & (draw.token <= F.lit(last[name])), F.lit(False))
    return taken


def take_first(df: DataFrame, draws: Mapping[str, Draw]) -> Column:
    return chosen(draws, cutoffs(df, draws))


def _bucket(token: str) -> Column:
    return F.conv(F.substring(token, 1, BUCKET_CHARS), 16, 10).cast("int")


def smallest(picks: DataFrame, by: str, need: Mapping[int, int]) -> DataFrame:
    """The rows of each group ``by`` with the ``need`` smallest draw keys in ``token`` (all, where there are fewer).

    Draw keys are uniform: one scan counts them per prefix of 16 bits, a second reads only the rows
    up to the prefix that completes a group.  The driver sees one row per group.  Ties of whole keys are all kept.
    """
    bucket, wanted = _bucket("token"), _literal_map(need)[F.col(by)]
    counts = picks.groupBy(by, bucket.alias("bucket")).agg(F.count("*").alias("rows"))
    before = W.partitionBy(by).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    below = counts.withColumn("below", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    last = below.where(F.col("below") < wanted).groupBy(by).agg(F.max("bucket").alias("bucket")).collect()
    if not last:
        return picks.where("false")
    near = picks.where(bucket <= _literal_map({r[by]: r["bucket"] for r in last})[F.col(by)])
    place = F.rank().over(W.partitionBy(by).orderBy("token"))
    return near.withColumn("place", place).where(F.col("place") <= wanted).drop("place")


def _literal_map(values: Mapping) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def key_histogram(df: DataFrame, draws: Mapping[str, Draw]) -> dict[str, np.ndarray]:
    """Rows of each draw per prefix of 16 bits of its (uniform) draw key, by one scan; ``n`` is not used.

    The driver receives at most 65,536 counts per draw.
    """
    member = [F.when(d.rule, F.struct(F.lit(name).alias("draw"), d.token.alias("token"))) for name, d in draws.items()]
    keys = df.select(F.explode(F.array_compact(F.array(*member))).alias("m")).select("m.draw", _bucket("m.token").alias("bucket"))
    table = keys.groupBy("draw", "bucket").agg(F.count("*").alias("rows")).toArrow()
    found = {name: np.zeros(1 << 4 * BUCKET_CHARS, np.int64) for name in draws}
    names = np.array(table.column("draw").to_pylist(), object)
    buckets, rows = table.column("bucket").to_numpy(), table.column("rows").to_numpy()
    for name, counts in found.items():
        own = names == name
        counts[buckets[own]] = rows[own]
    return found


def key_cutoffs(df: DataFrame, draws: Mapping[str, Draw], histogram: Mapping[str, np.ndarray]) -> dict[str, str | None]:
    """Largest draw key each draw takes, given the histogram of the same rules and keys.

    One scan reads the keys of the prefix in which a draw ends, 1/65,536 of its rows; draws
    that take all rows or end with a prefix need none.  ``None`` where a draw takes nothing.
    """
    result: dict[str, str | None] = {}
    bands, rest = {}, {}
    for name, draw in draws.items():
        upto = np.cumsum(histogram[name])
        if draw.n <= 0 or not upto[-1]:
            result[name] = None
            continue
        bucket = int(np.searchsorted(upto, min(draw.n, upto[-1])))
        prefix = f"{bucket:0{BUCKET_CHARS}x}"
        if draw.n >= upto[bucket]:
            result[name] = prefix + "g"  # behind every key of the prefix
        else:
            bands[name] = draw._replace(rule=draw.rule & draw.token.startswith(prefix))
            rest[name] = int(draw.n - (upto[bucket] - histogram[name][bucket]))
    if bands:
        member = [F.when(d.rule, F.struct(F.lit(n).alias("draw"), d.token.alias("token"))) for n, d in bands.items()]
        band = df.select(F.explode(F.array_compact(F.array(*member))).alias("m")).select("m.draw", "m.token")
        place = F.row_number().over(W.partitionBy("draw").orderBy("token"))
        edge = _literal_map(rest)[F.col("draw")]
        for row in band.withColumn("place", place).where(F.col("place") == edge).collect():
            result[row["draw"]] = row["token"]
    return result


def draw_rank(df: DataFrame, row_id: str, seed: int | str, by: list[str] = [], out: str = "rank") -> DataFrame:
    """Exact 1-based rank by draw key inside ``by``, spread over 65,536 even buckets per group.

    Draw keys are uniform, so a bucket holds 1/65,536 of its group; its offset
    comes from the bucket counts, a table of bounded size.
    """
    key, bucket, offset = "__key", "__bucket", "__offset"
    keyed = df.withColumn(key, draw_key(row_id, seed))
    keyed = keyed.withColumn(bucket, F.substring(key, 1, BUCKET_CHARS))
    counts = keyed.groupBy(*by, bucket).agg(F.count("*").alias("__rows"))
    before = W.partitionBy(*by).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    named = {c: f"__of_{c}" for c in [*by, bucket]}
    offsets = counts.select(
        *[F.col(c).alias(other) for c, other in named.items()],
        F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias(offset),
    )
    inside = W.partitionBy(*by, bucket).orderBy(key, row_id)
    ranked = keyed.withColumn("__in_bucket", F.row_number().over(inside))
    match = reduce(and_, [F.col(c).eqNullSafe(F.col(other)) for c, other in named.items()])
    return ranked.join(offsets, match).select(
        *df.columns, (F.col("__in_bucket") + F.col(offset)).alias(out)
    )


def running_sums(df: DataFrame, by: list[str], value: str, sums: list[str], descending: bool = False) -> DataFrame:
    """Inclusive running sums per group in value order, as ``upto_<name>``.

    ``df`` holds one row per (group, value).  Rows are sorted by range over all partitions and
    frozen; sums run inside a partition, and the totals of the earlier partitions of the group
    are added.  Ranges are cut by the number of rows, so neither a huge group nor values that lie close
    together end up in one task.
    """
    part = "__part"
    order = F.desc(value) if descending else F.asc(value)
    placed = freeze(df.orderBy(*by, order)).withColumn(part, F.shiftright(F.monotonically_increasing_id(), 33))
    totals = placed.groupBy(*by, part).agg(*[F.sum(c).alias(c) for c in sums])
    earlier = W.partitionBy(*by).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    named = {c: f"__of_{c}" for c in [*by, part]}
    offsets = totals.select(
        *[F.col(c).alias(other) for c, other in named.items()],
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"__before_{c}") for c in sums],
    )
    inside = W.partitionBy(*by, part).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    local = placed.select("*", *[F.sum(c).over(inside).alias(f"__local_{c}") for c in sums])
    match = reduce(and_, [F.col(c).eqNullSafe(F.col(other)) for c, other in named.items()])
    return local.join(offsets, match).select(
        *df.columns, *[(F.col(f"__local_{c}") + F.col(f"__before_{c}")).alias(f"upto_{c}") for c in sums]
    )


def with_position(df: DataFrame, order_by: list, out: str, start: int = 0) -> DataFrame:
    """Exact consecutive numbers in a total order, by a distributed sort.

    The sorted rows are frozen so that partition contents cannot change between
    counting the partitions and numbering their rows.  The table of offsets has
    one row per partition, which bounds the broadcast.
    """
    sorted_rows = freeze(df.orderBy(*order_by))
    mark, part, before = "__mark", "__part", "__before"
    marked = sorted_rows.withColumn(mark, F.monotonically_increasing_id())
    marked = marked.withColumn(part, F.shiftright(mark, 33))
    sizes = marked.groupBy(part).agg(F.count("*").alias("__rows"))
    previous = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(part, F.coalesce(F.sum("__rows").over(previous), F.lit(0)).alias(before))
    local = F.col(mark).bitwiseAND(F.lit(2**33 - 1))
    numbered = marked.join(F.broadcast(offsets), part)
    position = (local + F.col(before) + F.lit(start)).cast("long")
    return numbered.select(*df.columns, position.alias(out))
