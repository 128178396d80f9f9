"""Best-fit packing of documents into token sequences, by hierarchical residual rounds.

Pieces are spread over partitions, each of which packs its own by best fit in
decreasing order.  Full and nearly full sequences leave at once; underfull ones become the
items of the next round with fewer partitions, until one partition has seen all
that is left or a round no longer shrinks it.  A task never holds more than
``items_per_task`` items in expectation, and an item holds at most ``capacity``
members, so memory is bounded at any size.
"""

import math
import os
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.common import batch_of, worker_state
from corpuskit.session import freeze

MEMO_ENTRIES = 600_000  # space-delimited chunks a worker remembers the ids of

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
MEMBER = "struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long,offset:long>"
BINS = f"closed boolean, sequence_id long, used long, members array<{MEMBER}>"


class NotSeparable(Exception):
    """A text that cannot be cut at its spaces."""


class Memo(dict):
    """Ids of space-delimited chunks, found on first use; the lookup itself stays a plain dictionary's."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise NotSeparable
        ids = self[chunk] = self.encode(chunk)
        return ids


class ChunkEncoder:
    """Ids of a byte-level BPE tokenizer, remembered per space-delimited chunk.

    With the tokenizer's split pattern a text may be cut before every single space
    that stands between two other characters: no match crosses such a place.  Texts
    with other white space around a cut go to the tokenizer whole.
    """

    def __init__(self, definition: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(definition)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.tokenize = self.whole.model.tokenize
        self.split = regex.compile(PATTERN).findall
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        self.letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.later = Memo(lambda chunk: self._chunk(" " + chunk))
        self.first = Memo(self._chunk)
        self.parts: dict[str, bytes] = {}

    def _ids(self, match: str) -> bytes:
        if match.isascii() and match.isalpha():
            mapped = match
        else:
            mapped = match.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tokenize(mapped)]).tobytes()

    def _part(self, match: str) -> bytes:
        """Ids of one match; words after a space share the memo of whole chunks."""
        word = match[1:]
        if match[0] == " " and word.isalpha():
            return self.later[word]
        ids = self.parts.get(match)
        if ids is None:
            ids = self.parts[match] = self._ids(match)
        return ids

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isalpha() or (chunk[0] == " " and chunk[1:].isalpha()):
            return self._ids(chunk)
        return b"".join([self._part(match) for match in self.split(chunk)])

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if len(self.later) + len(self.first) + len(self.parts) > MEMO_ENTRIES:
            for memo in (self.later, self.first, self.parts):
                memo.clear()
        first, *rest = text.split(" ")
        try:
            if any(s in text for s in self.special):
                raise NotSeparable
            return b"".join([self.first[first], *map(self.later.__getitem__, rest)])
        except NotSeparable:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode every whole text, add ``end_id`` and cut what is longer than ``capacity``.

    A document of more than ``capacity`` ids becomes full pieces, after a first piece that
    takes the remainder.  Null and empty texts give the end id alone; a null id stays null;
    repeated rows give their pieces again; other columns are ignored.  ``tokenizer`` is the
    path of a tokenizer definition; the driver reads it and ships its bytes (1 to 2 MB).
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as file:
        definition = spark.sparkContext.broadcast(file.read())
    schema = pa.schema(
        [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    )
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches):
        encoder = worker_state(("chunk encoder", tokenizer), lambda: ChunkEncoder(definition.value))
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = memoryview(encoder.encode(text or "") + end)
                total = len(ids) // 4
                edge = total % capacity or min(total, capacity)
                start = piece = 0
                while start < total:
                    rows.append((doc_id, piece, start, edge - start, zlib.crc32(ids[4 * start : 4 * edge])))
                    start, edge, piece = edge, edge + capacity, piece + 1
            yield batch_of(schema, list(zip(*rows)) or [[]] * 5)

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(encode, PIECES)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of item positions: each item goes to the fullest bin that still takes it.

    ``sizes`` come in decreasing order.  Bins are kept by free space; a bit mask of the
    free spaces in use finds the smallest sufficient one in constant time.
    """
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins = 0, []
    for i, size in enumerate(sizes):
        fitting = mask >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            place = by_free[free].pop()
            if not by_free[free]:
                mask ^= 1 << free
        else:
            free, place = capacity, len(bins)
            bins.append([])
        bins[place].append(i)
        rest = free - size
        by_free[rest].append(place)
        mask |= 1 << rest
    return bins


def _round(packed_in: DataFrame, partitions: int, number: int, capacity: int, nearly_full: int) -> DataFrame:
    schema = pa.schema(
        [
            ("closed", pa.bool_()),
            ("sequence_id", pa.int64()),
            ("used", pa.int64()),
            (
                "members",
                pa.list_(
                    pa.struct(
                        [("doc_id", pa.int64()), ("piece", pa.int32())]
                        + [(c, pa.int64()) for c in ("start", "length", "ids_crc32", "offset")]
                    )
                ),
            ),
        ]
    )

    def pack(batches):
        items = []
        for batch in batches:
            items += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        # a total order, so that a repeated task builds the same sequences
        items.sort(key=lambda x: (-x[0], x[1][0]["doc_id"] is None, x[1][0]["doc_id"] or 0, x[1][0]["piece"], x[1][0]["ids_crc32"]))
        context = TaskContext.get()
        base = (number << 52) | ((context.partitionId() if context else 0) << 28)
        bins = best_fit([used for used, _ in items], capacity)
        for first in range(0, len(bins), 2000):
            closed, ids, used, members = [], [], [], []
            for n, chosen in enumerate(bins[first : first + 2000], first):
                place, content = 0, []
                for i in chosen:
                    content += [m | {"offset": m["offset"] + place} for m in items[i][1]]
                    place += items[i][0]
                closed.append(capacity - place <= nearly_full)
                ids.append(base | n)
                used.append(place)
                members.append(content)
            yield batch_of(schema, [closed, ids, used, members])

    first = F.col("members")[0]
    key = F.xxhash64(F.lit(number), first["doc_id"], first["piece"], first["start"])
    return packed_in.select("used", "members").repartition(partitions, key).mapInArrow(pack, BINS)


def _emptiest(items: DataFrame, most: int) -> int:
    """The largest fill up to which there are at most ``most`` items; one row per fill reaches the driver."""
    limit, total = 0, 0
    for used, n in sorted(items.groupBy("used").count().collect()):
        total += n
        if total > most:
            break
        limit = used
    return limit


def pack_pieces(
    pieces: DataFrame, capacity: int = 1024, items_per_task: int = 60_000, fan_in: int = 8, nearly_full: int = 0
) -> DataFrame:
    """Assign every piece a sequence and an offset in it.

    ``pieces`` has the columns of :func:`token_pieces`.  A sequence is closed once at most
    ``nearly_full`` tokens are free; the rest is packed again, in at most ``1 / fan_in`` as
    many partitions but never more than ``items_per_task`` items in one, down to one partition.  Where a round
    gains less than a twentieth before, what is left hardly fits together: its ``items_per_task`` emptiest
    sequences go to one last partition and the others stay as they are.  Best fit leaves
    at most one sequence of a partition half full or less, so the last partition gets all of those (of up to
    ``items_per_task`` partitions).  An empty table gives an empty table.
    """
    pieces = freeze(pieces)
    offset = F.lit(0).cast("long").alias("offset")
    member = F.struct("doc_id", "piece", "start", "length", "ids_crc32", offset)
    items = pieces.where(F.col("length") < capacity).select(
        F.col("length").alias("used"), F.array(member).alias("members")
    )
    full = pieces.where(F.col("length") >= capacity)
    own = (F.lit(1 << 62) + F.monotonically_increasing_id()).alias("sequence_id")
    done = full.select(F.col("doc_id"), "piece", "start", "length", "ids_crc32", own, offset)

    left = items.count()
    partitions, number = max(1, math.ceil(left / items_per_task)), 0
    while left:
        packed = freeze(_round(items, partitions, number, capacity, nearly_full))
        items, closed = packed.where(~F.col("closed")), packed.where("closed")
        before, left = left, items.count()
        if partitions == 1:
            closed, left = packed, 0
        elif left > 0.95 * before:
            limit = _emptiest(items, items_per_task)
            closed = packed.where(F.col("closed") | (F.col("used") > limit))
            items = items.where(F.col("used") <= limit)
            left, partitions = items.count(), 1
        else:
            partitions = max(math.ceil(partitions / fan_in), math.ceil(left / items_per_task))
        done = done.unionByName(closed.select("sequence_id", F.explode("members").alias("m")).select("m.*", "sequence_id"))
        number += 1
    return done


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, **options) -> DataFrame:
    """Token pieces of ``docs`` with their sequence and offset; see the two steps above."""
    return pack_pieces(token_pieces(docs, tokenizer, capacity, end_id), capacity, **options)
