"""Exact removal of long repeated substrings by distributed prefix doubling.

A position (a suffix) is named by its first 16 bytes, then by the pair of names at
offset 16 (32 bytes), then by the pair at offset ``length - 32`` (the threshold).  Spark
brings equal names together, each round ranks them anew, and positions whose name occurs in
one document only drop out.  Names are hashes, so ranks need no global numbering.  Runs are equal by 96 bits of
their whole bytes and 32 of their name, windows by 48 and 64 bits of their pair.

Sorting every position of a large corpus would cost many times the text.  Two exact
savings avoid that:

* The first round ranks sampled positions only.  Every ``length``-byte window is
  represented by the position with the smallest name in it, so equal windows have
  equal representatives, and windows whose representative is unique to a document are unique.
  The second rank, of pairs with the name 16 bytes before or after, is formed in the same exchange.
* Consecutive windows with one representative form a run.  A run whose whole bytes occur in
  a smaller document is settled at once.  Only the smallest document of each distinct run
  goes on to the later rounds, and only where other runs share its representative.

Documents travel in blocks of a few megabytes: names are ranked per block before they are
shuffled, so a passage that a third of all documents share sends one row
per block and not one per occurrence.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.common import WINDOW, batch_of, binary_values, by_bytes, joined, mix, window_hashes

FIRST = WINDOW  # bytes named by the first rank
CHUNK = 1 << 19  # bytes that are named together; keeps the working arrays small
NO_ID = np.iinfo(np.int64).max  # a null id is larger than every other
LOW_HALF = np.uint64(0xFFFFFFFF)
whole_digest = xxhash.xxh3_128_digest  # of a run's bytes

BLOCK = "block long, data binary"
ROWS = "bin long, block long, kind int, data binary"
REPLY = "block long, kind int, data binary"
SPANS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

_BLOCK = pa.schema([("block", pa.int64()), ("data", pa.binary())])
_ROWS = pa.schema([("bin", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])
_REPLY = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])
_SPANS = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
)


# ------------------------------------------------------------------- bytes ---
def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes, each split into byte planes so that equal high bytes vanish."""
    parts = [np.array([len(arrays)], "<i8").tobytes()]
    for a in arrays:
        parts.append(np.array([a.dtype.num, len(a)], "<i8").tobytes())
        parts.append(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() if len(a) else b"")
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack_arrays(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    count, place, arrays = int(np.frombuffer(raw, "<i8", 1)[0]), 8, []
    kinds = {np.dtype(k).num: np.dtype(k) for k in ("u1", "u2", "i4", "i8", "u8")}
    for _ in range(count):
        number, rows = np.frombuffer(raw, "<i8", 2, place)
        kind, rows = kinds[int(number)], int(rows)
        planes = np.frombuffer(raw, np.uint8, rows * kind.itemsize, place + 16).reshape(kind.itemsize, rows)
        arrays.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        place += 16 + rows * kind.itemsize
    return arrays


class Block:
    """Some documents: ids, which of them are null, which texts are missing, their bytes in one array with a gap after
    each, starts and lengths; ``rest`` holds their other columns, unread."""

    def __init__(self, ids: np.ndarray, values: list[bytes], null: np.ndarray, missing: np.ndarray, rest: bytes = b""):
        self.ids, self.null, self.missing, self.rest = ids, null, missing, rest
        self.bytes, self.starts, self.lengths = joined(values, 64)

    def dump(self) -> bytes:
        head = pack_arrays(self.ids, self.null.astype(np.uint8), self.missing.astype(np.uint8), self.lengths, np.frombuffer(self.rest, np.uint8))
        text = b"".join(self.bytes[s : s + n].tobytes() for s, n in zip(self.starts, self.lengths))
        body = zstandard.ZstdCompressor(level=3).compress(text)
        return np.array([len(head)], "<i8").tobytes() + head + body

    @classmethod
    def load(cls, data: bytes) -> "Block":
        size = int(np.frombuffer(data, "<i8", 1)[0])
        ids, null, missing, lengths, rest = unpack_arrays(data[8 : 8 + size])
        text = zstandard.ZstdDecompressor().decompress(data[8 + size :], max_output_size=int(lengths.sum()) + 1)
        ends = np.cumsum(lengths)
        values = [text[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist())]
        return cls(ids, values, null.astype(bool), missing.astype(bool), rest.tobytes())


# ------------------------------------------------------------------- names ---
def pair_names(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * np.uint64(0xFF51AFD7ED558CCD) + (right ^ (right >> np.uint64(31))))


def reach(length: int) -> int:
    """How far the name before or after a representative may be, so that every window holds one of them."""
    return min(FIRST, (length - FIRST + 1) // 2)


def runs_of(block: Block, length: int):
    """Runs of consecutive windows with one representative, over all documents of the block.

    Returns document index, first window, windows, representative (places in the block's
    array), the representative's name and short forms of the names ``reach`` before and after it.  The smallest name represents a window, the leftmost of
    equal ones; both depend on the window's bytes alone.
    """
    width = length - FIRST + 1
    places, apart = int(CHUNK + length).bit_length(), reach(length)
    low = np.uint64((1 << places) - 1)
    found = []
    pieces = []  # (document, first window, windows)
    for d, n in enumerate(block.lengths):
        total = int(n) - length + 1
        for at in range(0, total, CHUNK):
            pieces.append((d, int(block.starts[d]) + at, min(CHUNK, total - at)))
    # what lies between two pieces counts with the first, so places inside a chunk stay below ``low``
    extents = [q[1] - p[1] for p, q in zip(pieces, pieces[1:])] + [p[2] for p in pieces[-1:]]
    for a, b in by_bytes(extents, CHUNK):
        some = pieces[a:b]
        begin, end = some[0][1], some[-1][1] + some[-1][2] + length - 1
        names = window_hashes(block.bytes[begin:], end - begin - FIRST + 1)
        keys = (names & ~low) | (np.arange(len(names), dtype=np.uint64) & low)
        least, span = keys, 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        chosen = (least & low).astype(np.int64)
        docs = np.repeat([p[0] for p in some], [p[2] for p in some])
        windows = np.concatenate([np.arange(p[1] - begin, p[1] - begin + p[2]) for p in some])
        chosen = chosen[windows]
        new = np.ones(len(windows), bool)
        new[1:] = (chosen[1:] != chosen[:-1]) | (docs[1:] != docs[:-1])
        head = np.flatnonzero(new)
        rep = chosen[head]
        size = np.diff(np.append(head, len(windows)))
        before = (names[np.maximum(rep - apart, 0)] >> np.uint64(48)).astype(np.uint16)
        after = (names[np.minimum(rep + apart, len(names) - 1)] >> np.uint64(48)).astype(np.uint16)
        # least names crowd at the low end of their range; mixed once more they spread over all bins
        found.append((docs[head], windows[head] + begin, size, rep + begin, mix(names[rep]), before, after))
    if not found:
        empty, short = np.zeros(0, np.int64), np.zeros(0, np.uint16)
        return empty, empty, empty, empty, np.zeros(0, np.uint64), short, short
    return tuple(np.concatenate(c) for c in zip(*found))


class Ranked:
    """The distinct runs of a block in name order, with the smallest document of each.

    The low half of ``name`` belongs to the digest of the whole run.
    """

    def __init__(self, block: Block, length: int):
        self.block, self.length = block, length
        self.doc, self.first, self.size, self.rep, name, before, after = runs_of(block, length)
        # windows from ``split`` on hold the name after the representative, earlier ones the name before
        self.split = np.clip(self.rep - (length - FIRST - reach(length)), self.first, self.first + self.size)
        raw = memoryview(block.bytes)
        ends = self.first + self.size + length - 1
        digests = b"".join(
            whole_digest(raw[a:b], c) for a, b, c in zip(self.first.tolist(), ends.tolist(), (self.rep - self.first).tolist())
        )
        high, whole = np.frombuffer(digests, ">u8").reshape(-1, 2).T.astype(np.uint64)
        # a run is known by 32 bits of its name and, as many runs share name and sides, 96 bits of its whole bytes
        name = (name & ~LOW_HALF) | (high & LOW_HALF)
        before = np.where(self.split > self.first, before, 0).astype(np.uint16)
        after = np.where(self.split < self.first + self.size, after, 0).astype(np.uint16)
        self.id = block.ids[self.doc]
        order = np.lexsort((self.id, whole, name))
        name, whole = name[order], whole[order]
        new = np.ones(len(order), bool)
        new[1:] = (name[1:] != name[:-1]) | (whole[1:] != whole[:-1])
        self.entry = np.empty(len(order), np.int64)  # entry of each run
        self.entry[order] = np.cumsum(new) - 1
        self.name, self.whole, self.least = name[new], whole[new], self.id[order][new]
        self.before, self.after = before[order][new], after[order][new]
        heads = np.flatnonzero(new)
        self.most = self.id[order][np.append(heads[1:], len(order)) - 1] if len(order) else self.least


def _slices(names: np.ndarray, bins: int):
    """Ranges of sorted names by bin; a bin is an equal share of the name space."""
    place = (names >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)
    edges = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(names) else np.zeros(0, np.int64)
    for a, b in zip(edges, np.append(edges[1:], len(names))):
        yield int(place[a]), int(a), int(b)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return batch_of(_ROWS, list(zip(*rows)) or [[]] * 4)


# ------------------------------------------------------------------- steps ---
def _dump_rest(rows: pa.Table) -> bytes:
    """All columns but the first two."""
    rest = rows.select(range(2, rows.num_columns))
    if not rest.num_columns:
        return b""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rest.schema) as writer:
        writer.write_table(rest)
    return sink.getvalue().to_pybytes()


def _cut(batches, limit: int):
    """(number, block) of consecutive rows of a scan, about ``limit`` bytes each; id and text come first.

    The number is a digest of the block's place and rows.  Every scan of the table must give the same
    blocks; if one is split in another way, its answers find no block and the job fails.
    """
    context = TaskContext.get()
    part, place = context.partitionId() if context else 0, 0
    waiting, total, rows = [], 0, 0

    def flush():
        whole = pa.Table.from_batches(waiting).combine_chunks()
        ids = whole.column(0).to_pylist()
        null = np.array([i is None for i in ids], bool)
        values = [v for part in whole.column(1).chunks for v in binary_values(part)]
        missing = whole.column(1).is_null().to_numpy()
        numbers = np.array([NO_ID if i is None else i for i in ids], np.int64)
        block = Block(numbers, values, null, missing, _dump_rest(whole))
        named = np.array([part, place], np.int64).tobytes() + block.ids.tobytes() + block.lengths.tobytes()
        return xxhash.xxh3_64_intdigest(named) >> 1, block

    for batch in batches:  # where blocks are cut must not depend on where batches are
        start = 0
        for i, size in enumerate(pa.compute.binary_length(batch.column(1).cast(pa.binary())).to_pylist()):
            size = size or 0
            if rows and total + size > limit:
                waiting.append(batch.slice(start, i - start))
                yield flush()
                waiting, total, rows, place, start = [], 0, 0, place + 1, i
            total, rows = total + size, rows + 1
        waiting.append(batch.slice(start))
    if rows:
        yield flush()
    waiting.clear()
    pa.default_memory_pool().release_unused()


def _blocks(docs: DataFrame, limit: int) -> DataFrame:
    def build(batches):
        for number, block in _cut(batches, limit):
            yield batch_of(_BLOCK, [[number], [block.dump()]])

    return docs.mapInArrow(build, BLOCK)


def _first_ranks(docs: DataFrame, limit: int, length: int, bins: int) -> DataFrame:
    def rank(batches):
        for number, block in _cut(batches, limit):
            r = Ranked(block, length)
            rows = []
            for place, a, b in _slices(r.name, bins):
                same = r.least[a:b] == r.most[a:b]
                sides = r.before[a:b], r.after[a:b]
                packed = pack_arrays(r.name[a:b], r.whole[a:b], *sides, r.least[a:b], same.astype(np.uint8), np.arange(a, b, dtype=np.int32))
                rows.append((place, number, 0, packed))
            yield _rows(rows)

    return docs.mapInArrow(rank, ROWS)


def _check(blocks: pa.Table, answers: pa.Table) -> None:
    if answers.num_rows and not blocks.num_rows:
        raise ValueError("the table was split differently when it was read again; give the operator a stored table")


def _gather(tables: pa.Table, columns: int):
    parts = [unpack_arrays(x.as_py()) for x in tables.column("data")]
    owner = np.repeat(np.array(tables.column("block"), np.int64), [len(p[0]) for p in parts])
    return owner, [np.concatenate([p[c] for p in parts]) for c in range(columns)]


def _answers(owner: np.ndarray, kind: int, *arrays: np.ndarray) -> pa.Table:
    order = np.argsort(owner, kind="stable")
    owner = owner[order]
    edges = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else []
    rows = [
        (int(owner[a]), kind, pack_arrays(*[x[order[a:b]] for x in arrays]))
        for a, b in zip(edges, np.append(edges[1:], len(owner)))
    ]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [[]] * 3, _REPLY)], schema=_REPLY)


def _groups(*keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _settle_first(table: pa.Table) -> pa.Table:
    """Per distinct run: its smallest document, and which of its sides go on to the next rank.

    The next rank is that of the pair with the name before, or after, the representative: a side goes on if
    runs of other smallest documents share the pair.  Answers go to blocks whose copies are larger than
    the smallest document, and to blocks that hold the smallest document of a run that goes on.
    """
    owner, (name, whole, before, after, least, same, entry) = _gather(table, 7)
    order = np.lexsort((least, whole, name))
    owner, name, whole, before, after, least, same, entry = (x[order] for x in (owner, name, whole, before, after, least, same, entry))
    run = _groups(name, whole)
    name >>= np.uint64(32)  # without what it holds of the whole
    low = np.repeat(least[run], np.diff(np.append(run, len(name)))) if len(name) else least
    goes = np.zeros(len(name), np.uint8)
    for bit, side in ((1, before), (2, after)):
        order = np.lexsort((side, name))
        pair = _groups(name[order], side[order])
        if len(pair):
            lows = low[order]
            differ = np.minimum.reduceat(lows, pair) != np.maximum.reduceat(lows, pair)
            goes[order[np.repeat(differ, np.diff(np.append(pair, len(order))))]] |= bit
    goes[least != low] = 0
    told = (goes > 0) | (least > low) | (same == 0)
    return _answers(owner[told], 0, entry[told], low[told], goes[told])


def _window_pairs(block: Block, windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For windows of the block: the 32-byte names at their start and at ``length - 32``.

    Doubled from the 16-byte names at four offsets.
    """
    offsets = (0, FIRST, length - 2 * FIRST, length - FIRST)
    names = [np.empty(len(windows), np.uint64) for _ in offsets]
    for first in range(0, len(windows), CHUNK):
        at = windows[first : first + CHUNK]
        for into, offset in zip(names, offsets):
            rows = np.lib.stride_tricks.sliding_window_view(block.bytes, FIRST)[at + offset]
            words = np.ascontiguousarray(rows).view("<u8")
            left = words[:, 0] * np.uint64(0x9FB21C651E98DF25)
            left ^= left >> np.uint64(35)
            into[first : first + CHUNK] = mix(left + words[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F))
    return pair_names(names[0], names[1]), pair_names(names[2], names[3])


def _apply_first(length: int, bins: int):
    def apply(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        _check(blocks, replies)
        rows = []
        for number, data in zip(blocks.column("block").to_pylist(), blocks.column("data").to_pylist()):
            if not replies.num_rows:
                continue
            r = Ranked(Block.load(data), length)
            low = np.full(len(r.name), NO_ID, np.int64)
            goes = np.zeros(len(r.name), np.uint8)
            for reply in replies.column("data"):
                entry, least, bits = unpack_arrays(reply.as_py())
                low[entry], goes[entry] = least, bits
            settled = r.id > low[r.entry]
            bits = np.where(r.id == low[r.entry], goes[r.entry], 0)
            split = r.split
            early, late = np.flatnonzero((bits & 1 > 0) & (split > r.first)), np.flatnonzero((bits & 2 > 0) & (split < r.first + r.size))
            first = np.concatenate([r.first[early], split[late]])
            size = np.concatenate([split[early] - r.first[early], (r.first + r.size - split)[late]])
            windows = np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            ids = np.repeat(r.id[np.concatenate([early, late])], size)
            left, right = _window_pairs(r.block, windows, length)
            left &= ~np.uint64(0xFFFF)  # many windows share a left name, so the right one stays whole
            order = np.lexsort((ids, right, left))
            left, right, ids = left[order], right[order], ids[order]
            heads = _groups(left, right, ids)
            of = np.empty(len(order), np.int32)
            of[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(order))))
            rows.append((-1 - number, number, 1, pack_arrays(r.first[settled], r.size[settled].astype(np.int32), first, size.astype(np.int32), of)))
            left, right, ids = left[heads], right[heads], ids[heads]
            for place, a, b in _slices(left, bins):
                rows.append((place, number, 2, pack_arrays(left[a:b], right[a:b], ids[a:b], np.arange(a, b, dtype=np.int32))))
        return pa.Table.from_batches([_rows(rows)])

    return apply


def _settle_pairs(table: pa.Table) -> pa.Table:
    """Rank the pairs: names of one document drop out after 32 bytes, the rest are ranked at the threshold.

    What a block has to remember about itself comes in a bin of its own and passes through.
    """
    if table.column("kind")[0].as_py() == 1:
        return table.select(_REPLY.names)
    owner, (left, right, ids, entry) = _gather(table, 4)
    order = np.lexsort((ids, left))
    ranks = _groups(left[order])
    sizes = np.diff(np.append(ranks, len(order)))
    several = np.repeat(ids[order][ranks] != ids[order][ranks + sizes - 1], sizes) if len(ranks) else np.zeros(0, bool)
    keep = order[several]
    owner, left, right, ids, entry = (x[keep] for x in (owner, left, right, ids, entry))
    order = np.lexsort((ids, right, left))
    owner, left, right, ids, entry = (x[order] for x in (owner, left, right, ids, entry))
    pairs = _groups(left, right)
    low = np.repeat(ids[pairs], np.diff(np.append(pairs, len(ids)))) if len(pairs) else ids
    repeated = ids > low
    return _answers(owner[repeated], 3, entry[repeated])


def _remove(length: int):
    def remove(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        _check(blocks, replies)
        out = []
        kinds = replies.column("kind").to_pylist()
        datas = replies.column("data")
        for data in blocks.column("data").to_pylist():
            block = Block.load(data)
            change = np.zeros(len(block.bytes) + 1, np.int64)
            repeated = [unpack_arrays(d.as_py())[0] for k, d in zip(kinds, datas) if k == 3]
            for k, d in zip(kinds, datas):
                if k != 1:
                    continue
                first, size, later, sizes, of = unpack_arrays(d.as_py())
                np.add.at(change, first, 1)
                np.add.at(change, first + size + length - 1, -1)
                if repeated:
                    ends = np.cumsum(sizes)
                    windows = np.repeat(later - ends + sizes, sizes) + np.arange(len(of))
                    mark = np.zeros(int(of.max()) + 1 if len(of) else 0, bool)
                    mark[np.concatenate(repeated)] = True
                    also = windows[mark[of]]
                    np.add.at(change, also, 1)
                    np.add.at(change, also + length, -1)
            gone = np.cumsum(change[:-1]) > 0
            for doc_id, null, start, n in zip(block.ids.tolist(), block.null, block.starts.tolist(), block.lengths.tolist()):
                own, text = gone[start : start + n], block.bytes[start : start + n]
                removed = int(own.sum())
                spans = int(own[:1].sum() + (own[1:] & ~own[:-1]).sum()) if removed else 0
                kept = text[~own] if removed else text
                out.append((None if null else doc_id, n, removed, spans, hashlib.sha256(kept.tobytes()).hexdigest(), own))
        return out

    return remove


def _spans(length: int):
    remove = _remove(length)

    def spans(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        rows = [r[:5] for r in remove(blocks, replies)]
        return pa.Table.from_batches([batch_of(_SPANS, list(zip(*rows)) or [[]] * 5)])

    return spans


def _search(rows: DataFrame, length: int, block_bytes: int, bin_bytes: int):
    """(blocks, answers): everything that decides which windows are repeated."""
    if length < 2 * FIRST:
        raise ValueError(f"length must be at least {2 * FIRST}")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bins = max(1, -(-total // bin_bytes))
    narrow = rows.select("doc_id", "text")
    blocks = _blocks(rows, block_bytes)  # both steps below read the same exchange of texts
    first = _first_ranks(narrow, block_bytes, length, bins).groupBy("bin").applyInArrow(_settle_first, REPLY)
    both = blocks.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(_apply_first(length, bins), ROWS)
    answers = both.groupBy("bin").applyInArrow(_settle_pairs, REPLY)
    return blocks.groupBy("block").cogroup(answers.groupBy("block"))


def repeated_spans(
    docs: DataFrame,
    length: int = 50,
    block_bytes: int = 4 << 20,
    bin_bytes: int = 12 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per document: bytes, bytes removed, maximal removed runs, SHA-256 of what is kept.

    A byte goes if a ``length``-byte string that covers it also starts in a document with a
    smaller id.  Null and empty texts have no bytes.  Repeated rows of one id do not remove
    each other; rows with a null id are larger than every other and do not
    remove each other.  Other columns are ignored.  ``docs`` must be a scan of a table, so that a
    repeated task sees the same rows.  A task holds one block (``block_bytes``, or one longer
    document) or one bin (names of ``bin_bytes`` of text); both are sizes of work and not
    limits on the data.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _search(rows, length, block_bytes, bin_bytes).applyInArrow(_spans(length), SPANS)


def without_repeats(docs: DataFrame, length: int = 50, block_bytes: int = 4 << 20, bin_bytes: int = 12 << 20) -> DataFrame:
    """``docs`` (with ``doc_id`` and ``text``) with the repeated bytes cut from each text.

    Same rules as :func:`repeated_spans`.  All rows and columns stay; a text without a cut stays as
    it is, null included.  A character that a cut divides goes as a whole.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *[F.col(f"`{c}`") for c in rest])
    remove = _remove(length)

    def keep(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        _check(blocks, replies)
        tables = []
        for i in range(blocks.num_rows):
            block = Block.load(blocks.column("data")[i].as_py())
            texts, ids = [], []
            for row, start, n in zip(remove(blocks.slice(i, 1), replies), block.starts.tolist(), block.lengths.tolist()):
                ids.append(row[0])
                if n == 0 and block.missing[len(texts)]:
                    texts.append(None)
                    continue
                data = block.bytes[start : start + n]
                texts.append((data[~row[5]] if row[2] else data).tobytes().decode("utf-8", "ignore"))
            columns = [pa.array(ids, pa.int64()), pa.array(texts, pa.string())]
            if block.rest:
                columns += pa.ipc.open_stream(block.rest).read_all().combine_chunks().columns
            tables.append(pa.Table.from_arrays(columns, names=["doc_id", "text", *rest]))
        return pa.concat_tables(tables)

    return _search(rows, length, block_bytes, bin_bytes).applyInArrow(keep, rows.schema).select(*docs.columns)
