"""SimHash near-duplicates, searched by the generalised pigeonhole principle.

The bits are grouped into partitions of correlated bits.  Two fingerprints within
``max_bits`` differ by at most ``t_i`` in some partition ``i`` whenever the thresholds sum to
``max_bits - m + 1``; a threshold of -1 leaves a partition out.  The number of
partitions and the unequal thresholds are chosen by dynamic programming on estimated candidate counts.
Each fingerprint is stored under its own value of a partition and probes the values
within the threshold; candidates are verified by their bit distance.

Buckets with many fingerprints (a large group of near copies shares its values) are not paired.
Their fingerprints are linked exactly by shared neighbours instead: two
fingerprints are within ``max_bits`` if and only if a value lies within half of it of both,
so each emits its own neighbourhood once and no pairs arise.
"""

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.common import batch_of, binary_values
from corpuskit.llm.components import components
from corpuskit.session import freeze

BITS = 64
PAIRED = 32  # rows of a bucket that are compared with each other; larger ones take the exact other way


def simhash(text: bytes, shingle: int = 3) -> int:
    """Fingerprint of one text: ASCII lower case, words between ASCII white space, XXH64 with seed 42."""
    words = text.lower().split()
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return hashed(b" ".join(words), 42)
    over, total = np.zeros(BITS, np.int64), len(words) - shingle + 1
    for first in range(0, total, 1 << 16):
        some = words[first : min(first + (1 << 16), total) + shingle - 1]
        shifted = [some[i:] for i in range(shingle)]
        values = np.fromiter((hashed(b" ".join(s), 42) for s in zip(*shifted)), np.uint64)
        over += np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(over * 2 > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one signed 64-bit fingerprint per row; null and wordless texts give 0."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def fingerprint(batches):
        for batch in batches:
            values = np.array([simhash(t, shingle) for t in binary_values(batch.column(1))], np.uint64)
            yield batch_of(schema, [batch.column(0), values.view(np.int64)])

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(fingerprint, "doc_id long, fp long")


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, share of ones per bit and correlations between bits; 64 x 64 sums reach the driver."""
    schema = pa.schema([("cell", pa.int32()), ("n", pa.int64())])

    def sums(batches):
        total = np.zeros((BITS + 1, BITS + 1), np.int64)
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            ones = np.unpackbits(values.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.hstack([ones, np.ones((len(ones), 1), np.uint8)]).astype(np.float32)
            total += (ones.T @ ones).astype(np.int64)
        yield batch_of(schema, [np.arange(total.size), total.ravel()])

    rows = prints.select("fp").mapInArrow(sums, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    total = np.zeros((BITS + 1) ** 2)
    for cell, n in rows.collect():
        total[cell] = n
    total = total.reshape(BITS + 1, BITS + 1)
    rows = total[BITS, BITS]
    p = total[BITS, :BITS] / max(rows, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return int(rows), p, (total[:BITS, :BITS] / max(rows, 1) - np.outer(p, p)) / np.outer(spread, spread)


def group_bits(correlation: np.ndarray, m: int) -> list[list[int]]:
    """``m`` groups of near-equal width; each grows by the bit most correlated with it."""
    strength = np.abs(correlation)
    left, groups = list(range(BITS)), []
    for i in range(m):
        width = (BITS - sum(map(len, groups))) // (m - i)
        group = [max(left, key=lambda b: (strength[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < width:
            best = max(left, key=lambda b: (strength[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def candidates(rows: int, p: np.ndarray, group: list[int], collisions: float, limit: int) -> list[float]:
    """Estimated pairs within 0..limit bits in a group: measured for 0, then scaled by independent bits."""
    within = np.zeros(limit + 2)
    within[0] = 1.0
    for b in group:
        differ = 2 * p[b] * (1 - p[b])
        within = within * (1 - differ) + np.concatenate([[0.0], within[:-1]]) * differ
    independent = np.cumsum(within[: limit + 1])
    pairs = rows * (rows - 1) / 2
    scale = max(collisions, pairs * independent[0]) / max(independent[0], 1e-300)
    return [min(pairs, scale * share) for share in independent]


def allocate(costs: list[list[float]], max_bits: int) -> tuple[float, list[int]]:
    """Thresholds from -1 upwards with the least summed cost among those that sum to max_bits - m + 1.

    ``costs[i][t + 1]`` is the cost of threshold ``t`` in partition ``i``; dynamic programming over partitions.
    """
    best = {0: (0.0, [])}  # thresholds so far, each plus one -> cost, choice
    for row in costs:
        reached = {}
        for used, (cost, choice) in best.items():
            for t, extra in enumerate(row):
                option = (cost + extra, [*choice, t - 1])
                if used + t not in reached or option < reached[used + t]:
                    reached[used + t] = option
        best = reached
    return best[max_bits + 1]


def plan_partitions(prints: DataFrame, max_bits: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition in use, from statistics of all fingerprints."""
    rows, p, correlation = bit_statistics(prints)
    layouts = {m: group_bits(correlation, m) for m in range(1, max_bits + 2)}
    keyed = [(m, i, g) for m, groups in layouts.items() for i, g in enumerate(groups) if m > 1]
    values = F.explode(F.array(*[F.struct(F.lit(n).alias("at"), _masked(g).alias("value")) for n, (_, _, g) in enumerate(keyed)])) if keyed else None
    measured = {}
    if keyed and rows:
        counts = prints.select(values.alias("v")).groupBy("v.at", "v.value").agg(F.count("*").cast("double").alias("n"))
        same = counts.groupBy("at").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"))
        measured = {(keyed[r["at"]][0], keyed[r["at"]][1]): r["pairs"] for r in same.collect()}
    options = []
    for m, groups in layouts.items():
        costs = []
        for i, g in enumerate(groups):
            found = candidates(rows, p, g, measured.get((m, i), 0.0), max_bits)
            probes = np.cumsum([comb(len(g), t) for t in range(max_bits + 1)]) * float(rows)
            costs.append([0.0, *[c + n for c, n in zip(found, probes)]])
        cost, thresholds = allocate(costs, max_bits)
        options.append((cost, m, thresholds))
    _, m, thresholds = min(options)
    return [(g, t) for g, t in zip(layouts[m], thresholds) if t >= 0]


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _flips(bits: list[int], most: int) -> list[int]:
    return [_signed(sum(1 << b for b in c)) for t in range(1, most + 1) for c in combinations(bits, t)]


def _masked(bits: list[int]):
    return F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in bits))))


def links(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """Edges (a, b) between roots of distinct fingerprints that connect all within ``max_bits``.

    ``prints`` has distinct ``fp`` and a ``root``.  All light candidate pairs that verify are
    edges; in heavy buckets each fingerprint is tied to the least root around each shared neighbour.
    """
    plan = plan_partitions(prints, max_bits)
    forms = []
    for i, (bits, threshold) in enumerate(plan):
        value = _masked(bits)
        forms.append(F.struct(F.lit(i).alias("at"), value.alias("value"), F.lit(True).alias("home")))
        forms += [
            F.struct(F.lit(i).alias("at"), value.bitwiseXOR(F.lit(f)).alias("value"), F.lit(False).alias("home"))
            for f in _flips(bits, threshold)
        ]
    probes = prints.select("fp", "root", F.explode(F.array(*forms)).alias("p")).select("fp", "root", "p.*")
    met = probes.groupBy("at", "value").agg(F.count("*").alias("n"), F.max("home").alias("met"))
    met = met.where("n > 1 and met").select("at", "value", "n")
    rows = freeze(probes.join(met.hint("merge"), ["at", "value"]))  # all sides grow with the table

    light = rows.where(F.col("n") <= PAIRED).groupBy("at", "value")
    light = light.agg(F.collect_list(F.struct("fp", "root", "home")).alias("x"))
    pair = light.select("x", F.explode("x").alias("l")).select("l", F.explode("x").alias("r"))
    verified = (F.col("l.fp") < F.col("r.fp")) & (F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp"))) <= max_bits)
    pairs = pair.where(verified & (F.col("l.home") | F.col("r.home")))
    pairs = pairs.select(F.col("l.root").alias("a"), F.col("r.root").alias("b"))

    near, far = max_bits // 2, max_bits - max_bits // 2
    around = _flips(list(range(BITS)), far)
    inner = sum(comb(BITS, t) for t in range(1, near + 1))
    heavy = rows.where(F.col("n") > PAIRED).select("fp", "root").distinct()
    spread = F.array(
        F.struct(F.col("fp").alias("at"), F.lit(True).alias("near")),
        *[F.struct(F.col("fp").bitwiseXOR(F.lit(f)).alias("at"), F.lit(n < inner).alias("near")) for n, f in enumerate(around)],
    )
    ball = heavy.select("root", F.explode(spread).alias("v")).select("root", "v.*")
    star = ball.groupBy("at").agg(
        F.count("*").alias("n"), F.min(F.when(F.col("near"), F.col("root"))).alias("centre")
    ).where("n > 1 and centre is not null").select("at", "centre")
    tied = ball.join(star.hint("merge"), "at").select(F.col("root").alias("a"), F.col("centre").alias("b")).where("a != b")
    return pairs.unionByName(tied.distinct())


def near_duplicates(
    docs: DataFrame, shingle: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``; the smallest doc_id that links reach.

    Equal texts share a fingerprint, and only distinct fingerprints are searched.  Null and
    wordless texts have fingerprint 0 and link like any other.  Repeated rows stay; a
    null id keeps its row, takes the component of its fingerprint, and names none itself.
    Other columns are ignored.
    """
    rows = freeze(fingerprints(docs, shingle, id_col, text_col))
    prints = freeze(rows.groupBy("fp").agg(F.min("doc_id").alias("root")))
    named = prints.where("root is not null")
    found = components(links(named, max_bits))
    roots = named.join(found.hint("merge"), named["root"] == found["node"], "left")
    roots = roots.select("fp", F.coalesce("component", "root").alias("component_id"))
    return rows.join(roots.hint("merge"), "fp", "left").select("doc_id", "fp", "component_id")


def hexadecimal(column: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))
