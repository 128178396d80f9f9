"""Phrase collocations from count streams in prefix and suffix order.

Counts of one to three words are sorted by range, once by their words and once by their words
reversed.  In such a stream every phrase follows the shorter phrases it extends, so one
lockstep pass, which holds one word and one pair, gives each phrase the counts of its parts and each
pair the count of its most frequent extension.  No table of phrases is held or hashed to
join them; what a pass needs from other partitions is one row per partition.

Only phrases that occur ``min_count`` times matter, and so do all their parts.  Triples are therefore
counted where both pairs may be that frequent, by a Bloom filter of bounded size; what it
lets through in error is removed by the exact counts.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from corpuskit.llm.common import by_bytes, mix
from corpuskit.session import freeze

#: A-Z never remain in lower-cased bytes, so this letter can mark the edges of pieces.
EDGE = b"A"
EDGES = bytes(EDGE[0] if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))
BLOCK_BYTES = 4 << 20
HELD_WORDS = 2_000_000  # words a task counts before it hands out partial counts
FILTER_BITS = 28  # at most 2 ** 28 bits (32 MB) of the pair filter
BLOCK_BITS = 19
PROBES = 3

COUNTS = "lang string, phrase string, f long"


class Ids(dict):
    """Numbers of words in the order they are met; number 0 is the edge of a piece."""

    def __init__(self):
        super().__init__()
        self[EDGE] = 0

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def tokens(texts: list[bytes]) -> list[bytes]:
    """Words of all texts, with edges between pieces and between texts."""
    lowered = b"\n".join(texts).lower().translate(EDGES)
    return lowered.replace(EDGE, b" A ").split()


class Held:
    """Word numbers of one or more batches, by language."""

    def __init__(self):
        self.ids, self.arrays, self.words = Ids(), {}, 0

    def add(self, langs: list[str], texts: list[bytes]) -> None:
        by_lang: dict[str, list[bytes]] = {}
        for lang, text in zip(langs, texts):
            by_lang.setdefault(lang, []).append(text)
        for lang, own in by_lang.items():
            for start, end in by_bytes([len(t) for t in own], BLOCK_BYTES):
                words = tokens(own[start:end])
                numbers = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
                self.arrays.setdefault(lang, []).extend([numbers, np.zeros(1, np.int64)])
                self.words += len(words)

    def by_lang(self) -> Iterator[tuple[str, np.ndarray]]:
        for lang, arrays in self.arrays.items():
            yield lang, np.concatenate(arrays)


def _batch(lang: str, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    langs = pa.repeat(pa.scalar(lang, pa.string()), len(phrases))
    return pa.RecordBatch.from_arrays([langs, phrases.cast(pa.string()), pa.array(counts, pa.int64())], names=["lang", "phrase", "f"])


def _phrases(names: pa.Array, *numbers: np.ndarray) -> pa.Array:
    words = [names.take(pa.array(n)) for n in numbers]
    return words[0] if len(words) == 1 else pc.binary_join_element_wise(*words, b" ")


def _slices(lang: str, names: pa.Array, counts: np.ndarray, *numbers: np.ndarray, size: int = 200_000) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(counts), size):
        yield _batch(lang, _phrases(names, *[n[i : i + size] for n in numbers]), counts[i : i + size])


def _words_and_pairs(held: Held) -> Iterator[pa.RecordBatch]:
    """Partial counts of words and pairs; the empty phrase counts all words."""
    names = pa.array(list(held.ids), pa.binary())
    for lang, numbers in held.by_lang():
        counts = np.bincount(numbers, minlength=1)
        yield _batch(lang, pa.array([b""], pa.binary()), np.array([counts[1:].sum()]))
        found = np.flatnonzero(counts)
        found = found[found > 0]
        yield from _slices(lang, names, counts[found], found)
        left, right = numbers[:-1], numbers[1:]
        inside = (left > 0) & (right > 0)
        pairs, counts = np.unique(left[inside] << 32 | right[inside], return_counts=True)
        yield from _slices(lang, names, counts, pairs >> 32, pairs & 0xFFFFFFFF)


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def pair_bits(left: np.ndarray, right: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Places of pairs of word hashes in a filter of ``2 ** bits`` bits."""
    base = mix(left * np.uint64(0x9E3779B97F4A7C15) ^ mix(right))
    step = mix(base) | np.uint64(1)
    for probe in range(PROBES):
        yield (base + np.uint64(probe) * step) >> np.uint64(64 - bits)


def passing(pair_filter: np.ndarray, left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    keep = np.ones(len(left), bool)
    for places in pair_bits(left, right, bits):
        keep &= (pair_filter[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return keep


def _triples(held: Held, pair_filter: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Partial counts of the triples whose pairs both pass the filter."""
    words = list(held.ids)
    names = pa.array(words, pa.binary())
    for lang, numbers in held.by_lang():
        hashes = np.zeros(len(words), np.uint64)
        used = np.unique(numbers)
        hashes[used] = word_hashes(lang, [words[i] for i in used.tolist()])
        starts = np.flatnonzero((numbers[:-1] > 0) & (numbers[1:] > 0))
        passes = np.zeros(len(numbers) + 1, bool)
        for i in range(0, len(starts), 250_000):
            some = starts[i : i + 250_000]
            passes[some] = passing(pair_filter, hashes[numbers[some]], hashes[numbers[some + 1]], bits)
        begin = np.flatnonzero(passes[:-1] & passes[1:])
        pairs, pair = np.unique(numbers[begin] << 32 | numbers[begin + 1], return_inverse=True)
        triples, counts = np.unique(pair << 32 | numbers[begin + 2], return_counts=True)
        first = pairs[triples >> 32]
        yield from _slices(lang, names, counts, first >> 32, first & 0xFFFFFFFF, triples & 0xFFFFFFFF)


def _counted(docs: DataFrame, partial) -> DataFrame:
    """Counts of phrases per language; ``partial`` gives those of the held words of a task."""

    def count(batches):
        held = Held()
        for batch in batches:
            held.add(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            if held.words >= HELD_WORDS:
                yield from partial(held)
                held = Held()
        yield from partial(held)

    return docs.mapInArrow(count, COUNTS).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _pair_filter(pairs: DataFrame) -> tuple[bytes, int]:
    """The Bloom filter of frequent pairs, at most ``2 ** FILTER_BITS`` bits, put together from blocks."""
    bits = min(FILTER_BITS, max(BLOCK_BITS, (16 * pairs.count()).bit_length()))

    def places(batches):
        for batch in batches:
            by_lang: dict[str, list] = {}
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_lang.setdefault(lang, []).append(phrase.encode().split(b" "))
            for lang, own in by_lang.items():
                left, right = (word_hashes(lang, list(side)) for side in zip(*own))
                found = np.concatenate(list(pair_bits(left, right, bits))).astype(np.int64)
                blocks = pa.array(found >> BLOCK_BITS, pa.int64())
                yield pa.RecordBatch.from_arrays([blocks, pa.array(found & (1 << BLOCK_BITS) - 1)], names=["block", "place"])

    def fill(key, table):
        flags = np.zeros(1 << BLOCK_BITS, np.uint8)
        flags[table.column("place").to_numpy()] = 1
        packed = np.packbits(flags, bitorder="little").tobytes()
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([packed], pa.binary())})

    set_bits = pairs.select("lang", "phrase").mapInArrow(places, "block long, place long").distinct()
    whole = bytearray(1 << bits - 3)
    for row in set_bits.groupBy("block").applyInArrow(fill, "block long, bits binary").toLocalIterator():
        start = row["block"] << BLOCK_BITS - 3
        whole[start : start + len(row["bits"])] = row["bits"]
    return bytes(whole), bits


def lockstep(phrases: DataFrame, word_count: str, pair_count: str, extension: str) -> DataFrame:
    """Add the counts of leading parts to ``lang, a, b, c, f`` (absent words empty), and to pairs their longest reach.

    ``word_count`` is the count of ``a``, ``pair_count`` that of ``a b`` (triples), ``extension`` the largest count of
    a triple that begins with the pair (0 if none).  Other columns pass.  All parts of a phrase must be present.
    """
    order = ["lang", "a", "b", "c"]
    stream = freeze(phrases.repartitionByRange(*order).sortWithinPartitions(*order))
    ends = "part int, word array<string>, word_f long, pair array<string>, pair_f long, lead array<string>, lead_f long"

    def summarise(batches):
        word = pair = lead = None
        word_f = pair_f = lead_f = 0
        for batch in batches:
            for lang, a, b, c, f in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if not b:
                    word, word_f = [lang, a], f
                elif not c:
                    pair, pair_f = [lang, a, b], f
                elif word is None and pair is None:  # extends a pair of an earlier partition
                    lead, lead_f = [lang, a, b], max(lead_f, f)
        values = [TaskContext.get().partitionId(), word, word_f, pair, pair_f, lead, lead_f]
        types = [pa.int32(), *[pa.list_(pa.string()), pa.int64()] * 3]
        names = ["part", "word", "word_f", "pair", "pair_f", "lead", "lead_f"]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=names)

    carried, reach = {}, {}
    word = pair = None
    word_f = pair_f = 0
    for row in sorted(stream.select(*order, "f").mapInArrow(summarise, ends).collect(), key=lambda r: r["part"]):
        carried[row["part"]] = (word_f, pair_f)
        if row["word"]:
            word, word_f = row["word"], row["word_f"]
        if row["pair"]:
            pair, pair_f = row["pair"], row["pair_f"]
        if row["lead"]:
            key = tuple(row["lead"])
            reach[key] = max(reach.get(key, 0), row["lead_f"])
    shared = phrases.sparkSession.sparkContext.broadcast((carried, reach))  # one entry per partition
    rest = [c for c in phrases.columns if c not in (*order, "f")]
    schema = stream.select(*order, "f", *rest).schema
    for name in (word_count, pair_count, extension):
        schema = schema.add(name, T.LongType())

    def merge(batches):
        carried, reach = shared.value
        word_f, pair_f = carried.get(TaskContext.get().partitionId(), (0, 0))
        arrow = None
        pending, longest = None, 0

        def closed():
            return (*pending, word_f, None, max(longest, reach.get(pending[:3], 0)))

        for batch in batches:
            out = []
            arrow = batch.schema
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                _, a, b, c, f = row[:5]
                if c:
                    longest = max(longest, f)
                    out.append((*row, word_f, pair_f, None))
                    continue
                if pending is not None:
                    out.append(closed())
                    pending = None
                if b:
                    pending, pair_f, longest = row, f, 0
                else:
                    word_f = f
                    out.append((*row, None, None, None))
            yield as_batch(out, arrow)
        if pending is not None:
            yield as_batch([closed()], arrow)

    def as_batch(rows, arrow):
        types = [*arrow.types, pa.int64(), pa.int64(), pa.int64()]
        columns = list(zip(*rows)) or [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=schema.names)

    return stream.select(*order, "f", *rest).mapInArrow(merge, schema)


def phrase_counts(docs: DataFrame, min_count: int = 10, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(``lang, phrase, f`` of all phrases of one to three words with ``f >= min_count``, ``lang, n`` words).

    Texts are lower-cased (A-Z), cut at ``.,;:!?`` and line ends, and split at spaces and tabs; phrases stay
    inside a piece.
    """
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang")
    source = docs.select(lang, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    short = freeze(_counted(source, _words_and_pairs).where((F.col("f") >= min_count) | (F.col("phrase") == "")))
    totals = short.where("phrase = ''").select("lang", F.col("f").alias("n"))
    short = short.where((F.col("phrase") != "") & (F.col("f") >= min_count))
    shared, bits = _pair_filter(short.where(F.col("phrase").contains(" ")))
    shared = docs.sparkSession.sparkContext.broadcast(shared)

    def triples(held):
        return _triples(held, np.frombuffer(shared.value, np.uint8), bits)

    long = _counted(source, triples).where(F.col("f") >= min_count)
    return short.unionByName(long), totals


def mine(
    docs: DataFrame, min_count: int = 10, top: int = 2000, within: int = 50, lang_col: str = "lang", text_col: str = "text"
) -> DataFrame:
    """The ``top`` phrases of two or three words of each language: ``lang, rank, phrase, a, l, r, n, score``.

    ``a`` is the count of the phrase, ``l`` and ``r`` those of its two sides at the cut with the lowest
    score ``floor(10**6 * a * a / (l * r))`` (ties: the earlier cut), ``n`` the words of the language.  A pair inside a
    triple with at least ``within`` percent of its count is left out.  Ties in the rank go by larger ``a``, then
    by phrase in byte order.  Scores are exact for counts below 5 * 10**15.

    A null language is ``und``, a null or empty text has no words, repeated rows count again, an
    empty table gives no rows and other columns are ignored.
    """
    grams, totals = phrase_counts(docs, min_count, lang_col, text_col)
    words = F.split("phrase", " ")
    forward = grams.select("lang", *[F.coalesce(F.get(words, F.lit(i)), F.lit("")).alias(n) for i, n in enumerate("abc")], "f")
    prefixed = lockstep(forward, "l1", "l2", "right")
    absent = F.lit("")
    turned = prefixed.select(
        "lang",
        F.when(F.col("c") != "", F.col("c")).when(F.col("b") != "", F.col("b")).otherwise(F.col("a")).alias("a"),
        F.when(F.col("c") != "", F.col("b")).when(F.col("b") != "", F.col("a")).otherwise(absent).alias("b"),
        F.when(F.col("c") != "", F.col("a")).otherwise(absent).alias("c"),
        *["f", "l1", "l2", "right"],
    )
    both = lockstep(turned, "r1", "r2", "left").where("b != ''")
    reach = F.greatest("right", "left")
    kept = both.where((F.col("c") != "") | (reach == 0) | (100 * reach < within * F.col("f")))

    triple = F.col("c") != ""
    cuts = kept.select(
        "lang",
        F.when(triple, F.concat_ws(" ", "c", "b", "a")).otherwise(F.concat_ws(" ", "b", "a")).alias("phrase"),
        F.col("f").alias("a"),
        *["l1", "l2", "r1"],
        F.when(triple, F.col("r2")).otherwise(F.col("r1")).alias("rest"),
    )
    scored = cuts.withColumns({
        "early": F.call_function("div", *_product("a", "l1", "rest")),
        "late": F.call_function("div", *_product("a", "l2", "r1")),  # null without a second cut
    })
    late = F.coalesce(F.col("late") < F.col("early"), F.lit(False))
    lowest = scored.select(
        *["lang", "phrase", "a"],
        F.when(late, F.col("l2")).otherwise(F.col("l1")).alias("l"),
        F.when(late, F.col("r1")).otherwise(F.col("rest")).alias("r"),
        F.when(late, F.col("late")).otherwise(F.col("early")).alias("score"),
    )
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = lowest.withColumn("rank", place).where(F.col("rank") <= top).join(totals, "lang")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _product(whole: str, left: str, right: str) -> tuple[Column, Column]:
    """Numerator and denominator of a cut's score, exact beyond 64 bits."""
    exact = [F.col(c).cast("decimal(19,0)") for c in (whole, left, right)]
    return F.lit(10**6).cast("decimal(7,0)") * exact[0] * exact[0], exact[1] * exact[2]
