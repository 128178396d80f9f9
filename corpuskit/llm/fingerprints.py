"""Threshold-scaled document fingerprints.

A fingerprint keeps every shingle hash below a fixed fraction of the hash range, and
always the smallest one, so that no text with a shingle has an empty one.  Its size grows with the text,
and the same hash is kept or dropped in every document: the union of two fingerprints is the fingerprint
of both texts' shingles, and the share of common hashes estimates containment even between a page and a book.
Shingles are 16-byte strings of the UTF-8 text (a shorter text is one shingle).
"""

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.common import WINDOW, batch_of, binary_values, by_bytes, joined, window_hashes

FRACTION = 32  # one of so many hashes is kept
CHUNK = 1 << 20


def sketch(values: list[bytes], fraction: int = FRACTION) -> list[np.ndarray]:
    """Sorted distinct kept hashes of every text; an empty text has none."""
    limit = np.uint64((1 << 64) // fraction)
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(values)
    for a, b in by_bytes(list(map(len, values)), CHUNK):
        long = [i for i in range(a, b) if len(values[i]) >= WINDOW]
        for i in range(a, b):
            if 0 < len(values[i]) < WINDOW:
                out[i] = np.array([xxhash.xxh64_intdigest(values[i])], np.uint64)
        if not long:
            continue
        data, starts, lengths = joined([values[i] for i in long], 32)
        parts: list[list[np.ndarray]] = [[] for _ in long]
        least = np.full(len(long), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(data) - 32, CHUNK):  # more than one step for a very long text only
            count = min(CHUNK, len(data) - 32 - at)
            hashes = window_hashes(data[at:], count)
            first = np.clip(starts - at, 0, count)
            last = np.clip(starts + lengths - WINDOW + 1 - at, 0, count)
            some = np.flatnonzero(last > first)
            edges = np.stack([first[some], last[some]], 1).ravel()
            if not len(edges):
                continue
            padded = np.append(hashes, np.iinfo(np.uint64).max)  # the last edge may be the end
            least[some] = np.minimum(least[some], np.minimum.reduceat(padded, edges)[::2])
            kept = np.flatnonzero(hashes < limit)
            left, right = np.searchsorted(kept, first[some]), np.searchsorted(kept, last[some])
            for i, x, y in zip(some.tolist(), left.tolist(), right.tolist()):
                parts[i].append(hashes[kept[x:y]])
        for n, i in enumerate(long):
            out[i] = np.unique(np.concatenate([*parts[n], least[n : n + 1]]))
    return out


def merged(a: np.ndarray, b: np.ndarray, fraction: int = FRACTION) -> np.ndarray:
    """The fingerprint of the shingles of both; a smallest hash above the limit stays only if it is the smallest."""
    both = np.union1d(a, b)
    return both[(both < np.uint64((1 << 64) // fraction)) | (both == both[:1])]


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the smaller set that is in the larger one; 1 for two empty ones, 0 for one."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def resemblance(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of common shingles among all; 1 for two empty sets."""
    if not len(a) and not len(b):
        return 1.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def as_text(hashes: np.ndarray) -> str:
    """Sixteen hexadecimal digits per hash, in rising order."""
    return hashes.astype(">u8").tobytes().hex()


def fingerprints(docs: DataFrame, fraction: int = FRACTION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) for every row; null and empty texts have an empty one.

    Repeated rows and null ids stay; other columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def run(batches):
        for batch in batches:
            yield batch_of(schema, [batch.column(0), [as_text(s) for s in sketch(binary_values(batch.column(1)), fraction)]])

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, "doc_id long, fingerprint string")


def _in_order(rows: DataFrame, bucket_bytes: int) -> DataFrame:
    """(bucket, guest, doc_id, text), sorted within partitions; the next row in id order follows every row.

    Ids are cut into ranges at values that occur.  The first row of a range also goes to the end of the
    range before it as a guest (that of the first range to the last), so each text is shuffled once.
    """
    spark = rows.sparkSession
    total = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.min("doc_id").alias("low"), F.max(F.col("doc_id").isNull()).alias("null")).first()
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((total["bytes"] or 0) / bucket_bytes))
    shares = [i / wanted for i in range(1, wanted)]
    cuts = rows.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, shares)), max(10_000, 4 * wanted))).first()[0] if shares else None
    edges = np.array(sorted({*(cuts or []), *([] if total["low"] is None else [total["low"]])}), np.int64)
    null_first, last = bool(total["null"]), max(len(edges) - 1, 0)
    place = pa.struct([("bucket", pa.int32()), ("guest_of", pa.int32())])
    shipped = spark.sparkContext.broadcast(edges)

    def locate(ids: pa.Array) -> pa.Array:
        edges = shipped.value
        out = []
        for i in ids.to_pylist():
            if i is None:
                out.append({"bucket": 0, "guest_of": last})
                continue
            at = int(np.searchsorted(edges, i, "right")) - 1
            first = edges[at] == i
            out.append({"bucket": at, "guest_of": None if not first else at - 1 if at else None if null_first else last})
        return pa.array(out, place)

    from pyspark.sql.functions import arrow_udf

    placed = rows.withColumn("at", arrow_udf(locate, "struct<bucket:int,guest_of:int>")("doc_id"))
    own = F.struct(F.col("at.bucket").alias("bucket"), F.lit(False).alias("guest"))
    guest = F.when(F.col("at.guest_of").isNotNull(), F.struct(F.col("at.guest_of").alias("bucket"), F.lit(True).alias("guest")))
    sent = placed.select("doc_id", "text", F.explode(F.array_compact(F.array(own, guest))).alias("to"))
    sent = sent.select("to.bucket", "to.guest", "doc_id", "text").repartition(max(len(edges), 1), "bucket")
    return sent.sortWithinPartitions("bucket", "guest", "doc_id", "text")


def _pairs(batches):
    """(id, text, next text) of every row, from rows in order with guests."""
    waiting = None
    for batch in batches:
        for bucket, guest, doc_id, text in zip(*[c.to_pylist() for c in batch.columns]):
            text = text or ""
            if waiting and waiting[0] == bucket:
                yield waiting[1], waiting[2], text
                waiting = None
            if not guest:
                waiting = (bucket, doc_id, text)


def half_edits(
    docs: DataFrame, fraction: int = FRACTION, bucket_bytes: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how near both and the next text are.

    The edited text replaces the last half of the code points (rounded down) by as many of the next document in
    id order (all, if it has fewer); the first follows the last.  Rows with equal ids follow
    each other by text, null ids come before all others, null texts are empty.  Repeated rows stay; other
    columns are ignored.  ``near_edited`` and ``near_next`` are containment estimates, ``same_*`` resemblances.
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_chars", pa.int64())]
        + [(c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")]
        + [(c, pa.float64()) for c in ("near_edited", "near_next", "same_edited", "same_next")]
    )

    def report(rows: list[tuple]) -> pa.RecordBatch:
        edited = [(t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode() for _, t, n in rows]
        # the next text is mostly the following row's own
        texts = list(dict.fromkeys([x for _, t, n in rows for x in (t, n)]))
        prints = dict(zip(texts, sketch([t.encode() for t in texts], fraction)))
        out = []
        for (doc_id, text, after), data, changed in zip(rows, edited, sketch(edited, fraction)):
            own, following = prints[text], prints[after]
            digests = hashlib.sha256(data).hexdigest(), as_text(own), as_text(changed)
            near = containment(own, changed), containment(own, following), resemblance(own, changed), resemblance(own, following)
            out.append((doc_id, len(text), *digests, *near))
        return batch_of(schema, list(zip(*out)))

    def run(batches):
        rows, size = [], 0
        for row in _pairs(batches):
            rows.append(row)
            size += len(row[1])
            if size > CHUNK:
                yield report(rows)
                rows, size = [], 0
        if rows:
            yield report(rows)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, same_edited double, same_next double"
    )
    return _in_order(rows, bucket_bytes).mapInArrow(run, kind)
