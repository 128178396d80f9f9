"""Language-model scoring by the marginal likelihood of a subword lattice.

A word, led by a word mark, is a path through the pieces of an existing subword vocabulary, and its
probability sums over all its segmentations.  Pieces at the start of a word and within it are
different ones, as in the vocabulary, so nothing but the mark separates words, and a text is one
sequence of pieces and an end.  The vocabulary's scores are the first weights; a few expectation steps
over the training words, each weighted by how often it occurs, make them unigram probabilities.
A forward recursion in log space gives the marginal of a word (pieces never cross words, so the
lattice of a document is one state wide between words).
"""

import math
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.common import batch_of, mix
from corpuskit.session import scratch_path

END = ""  # no word is empty
MARK = b" "  # leads every word; no word holds one
FREQUENT = 400_000  # words with at least 1 / FREQUENT of all tokens, so at most that many
LN10 = math.log(10)


class Pieces(NamedTuple):
    """Byte strings by rising key; ``log_p`` are natural logarithms of unigram probabilities, ``longest`` the bytes of the longest."""

    keys: np.ndarray
    log_p: np.ndarray
    longest: int


def _key(hashes: np.ndarray, length: int) -> np.ndarray:
    return mix(hashes + np.uint64(length))


def _roll(hashes: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return hashes * np.uint64(0x100000001B3) + byte.astype(np.uint64) + np.uint64(1)


def read_vocabulary(vocabulary: str | dict[bytes, float]) -> tuple[list[bytes], np.ndarray]:
    """Byte strings and weights of a sentencepiece model, or of given pieces with weights.

    A space at the start marks pieces that begin a word; pieces across words are left out, as words are
    split before.  A-Z become lower case, as in the texts.  Scores of unigram models are log
    probabilities; those of a BPE model are negative ranks, for which a weight of 1 / (rank + 10) follows the
    usual fall of frequencies.  The mark and all single bytes are added, so every word has a segmentation.
    """
    weights = {bytes([b]): 1e-6 for b in range(256)}
    if isinstance(vocabulary, dict):
        weights.update(vocabulary)
    else:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=vocabulary)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        scores = np.array([model.get_score(i) for i in plain])
        ranks = bool((scores == np.round(scores)).all())
        for i, weight in zip(plain, 1 / (10 + np.maximum(0.0, -scores)) if ranks else np.exp(scores)):
            piece = model.id_to_piece(i).replace("▁", " ").encode().lower()
            if piece and MARK not in piece[1:]:
                weights[piece] = weights.get(piece, 0.0) + float(weight)
    pieces = sorted(weights)
    total = np.array([weights[p] for p in pieces])
    return pieces, total / total.sum()


def piece_table(pieces: list[bytes], probability: np.ndarray) -> tuple[Pieces, np.ndarray]:
    """Pieces in key order, and where each of the given ones stands."""
    keys = np.empty(len(pieces), np.uint64)
    for i, piece in enumerate(pieces):
        h = np.zeros(1, np.uint64)
        for b in piece:
            h = _roll(h, np.array([b], np.uint8))
        keys[i] = _key(h, len(piece))[0]
    order = np.argsort(keys)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    with np.errstate(divide="ignore"):
        return Pieces(keys[order], np.log(probability[order]), max(map(len, pieces))), place


def _known_bits(pieces: Pieces) -> np.ndarray:
    """Which first 20 bits of a key any piece has."""
    known = np.zeros(1 << 20, bool)
    known[pieces.keys >> np.uint64(44)] = True
    return known


def _arcs(words: np.ndarray, lengths: np.ndarray, pieces: Pieces, known: np.ndarray):
    """(start, end, rows, pieces) of every arc between places of the words of a byte matrix, shortest words first."""
    for start in range(words.shape[1]):
        h = np.zeros(len(words), np.uint64)
        for end in range(start + 1, min(words.shape[1], start + pieces.longest) + 1):
            first = int(np.searchsorted(lengths, end))  # words before it are shorter
            h[first:] = _roll(h[first:], words[first:, end - 1])
            keys = _key(h[first:], end - start)
            rows = np.flatnonzero(known[keys >> np.uint64(44)])
            keys = keys[rows]
            at = np.minimum(np.searchsorted(pieces.keys, keys), len(pieces.keys) - 1)
            found = pieces.keys[at] == keys
            if found.any():
                yield start, end, rows[found] + first, at[found]


def _matrix(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    width = int(lengths.max())
    return np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(-1, width), lengths


def _groups(words: list[bytes], rows: int = 4096):
    """Positions of words of similar length, so that matrices have little padding; no word is cut."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    start = 0
    while start < len(order):
        width = max(len(words[order[min(start + rows, len(order)) - 1]]), 1)
        stop = start + max(1, min(rows, (1 << 19) // width))
        yield order[start:stop]
        start = stop


def marginals(words: list[bytes], pieces: Pieces) -> np.ndarray:
    """Natural log probability of every word, summed over all segmentations in log space."""
    out, known = np.empty(len(words)), _known_bits(pieces)
    for some in _groups(words):
        table, lengths = _matrix([words[i] for i in some])
        forward = np.full((table.shape[1] + 1, len(some)), -np.inf)
        forward[0] = 0.0
        for start, end, rows, at in _arcs(table, lengths, pieces, known):
            # arcs come by rising start, and all arcs into a start come before those out of it
            forward[end, rows] = np.logaddexp(forward[end, rows], forward[start, rows] + pieces.log_p[at])
        out[some] = forward[lengths, np.arange(len(some))]
    return out


def expected_counts(words: list[bytes], counts: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Expected uses of each piece over all segmentations of the words, each taken as often as it is counted."""
    total, known = np.zeros(len(pieces.keys)), _known_bits(pieces)
    for some in _groups(words):
        table, lengths = _matrix([words[i] for i in some])
        arcs = list(_arcs(table, lengths, pieces, known))
        forward = np.full((table.shape[1] + 1, len(some)), -np.inf)
        backward = forward.copy()
        forward[0], backward[lengths, np.arange(len(some))] = 0.0, 0.0
        for start, end, rows, at in arcs:
            forward[end, rows] = np.logaddexp(forward[end, rows], forward[start, rows] + pieces.log_p[at])
        whole, times = forward[lengths, np.arange(len(some))], counts[some]
        for start, end, rows, at in reversed(arcs):
            backward[start, rows] = np.logaddexp(backward[start, rows], backward[end, rows] + pieces.log_p[at])
        for start, end, rows, at in arcs:
            use = times[rows] * np.exp(forward[start, rows] + pieces.log_p[at] + backward[end, rows] - whole[rows])
            np.add.at(total, at, use)
    return total


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case; null has none."""
    return (text or "").encode().lower().split()


def _word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) of all words of (text, learn), counted where ``learn`` holds; other words have 0."""
    schema = pa.schema([("word", pa.string()), ("c", pa.int64())])

    def count(batches):
        for batch in batches:
            learnt, other = Counter(), set()
            for text, learn in zip(*[c.to_pylist() for c in batch.columns]):
                learnt.update(words_of(text)) if learn else other.update(words_of(text))
            words = [*learnt, *(other - learnt.keys())]
            yield batch_of(schema, [pa.array(words, pa.binary()).cast(pa.string()), [learnt[w] for w in words]])

    return docs.mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _expectation(types: DataFrame, pieces: Pieces) -> np.ndarray:
    """Expected piece counts over all words by their counts; one row per piece reaches the driver."""
    schema = pa.schema([("at", pa.int32()), ("n", pa.float64())])
    shipped = types.sparkSession.sparkContext.broadcast(tuple(pieces))

    def count(batches):
        pieces = Pieces(*shipped.value)
        total = np.zeros(len(pieces.keys))
        for batch in batches:
            counts = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            total += expected_counts([MARK + w.encode() for w in batch.column(0).to_pylist()], counts, pieces)
        used = np.flatnonzero(total)
        yield batch_of(schema, [used.astype(np.int32), total[used]])

    total = np.zeros(len(pieces.keys))
    for at, n in types.select("word", "c").mapInArrow(count, "at int, n double").groupBy("at").agg(F.sum("n")).collect():
        total[at] = n
    return total


def _word_scores(types: DataFrame, pieces: Pieces) -> DataFrame:
    """``types`` plus ``spelled``: the log10 marginal of every word as pieces."""
    shipped = types.sparkSession.sparkContext.broadcast(tuple(pieces))

    def spell(batches):
        pieces = Pieces(*shipped.value)
        for batch in batches:
            words = [MARK + w.encode() for w in batch.column(0).to_pylist()]
            score = marginals(words, pieces) / LN10 if words else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, "spelled"])

    return types.mapInArrow(spell, "word string, c long, spelled double")


def score(
    docs: DataFrame,
    learn: Column,
    vocabulary: str | dict[bytes, float],
    steps: int = 3,
    word_share: float = 0.0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Log10 probabilities of every text under a model of the texts where ``learn`` is true.

    Returns ``doc_id``, ``n_tokens`` (words and one end), ``n_known`` (of them seen in training),
    ``train_tokens``, ``base_score`` (add-one word unigrams) and ``score`` (the lattice model).
    ``vocabulary`` is a sentencepiece model file or pieces with weights (see ``read_vocabulary``).
    A ``word_share`` above 0 (and below 1) mixes in arcs over whole training words: each word then has that
    share of its relative frequency and the rest of its marginal; by default segmentations alone decide.

    Null and empty texts are the end alone.  Repeated rows stay rows of their own; a null id stays
    null, and a null ``learn`` counts as false; other columns are ignored.  Without training rows the base
    knows no token, and the lattice has the vocabulary's own weights and an end as likely as all pieces.

    Words are counted in map tasks before they are shuffled.  Those with at least 1 / ``FREQUENT`` of all
    tokens are scored from a broadcast table (at most ``FREQUENT`` rows by definition), all other
    words of a document by a join, so no word is a hot key.  The two passes over ``docs`` meet by row
    number and a hash of the text; should they see the rows in another order, the job fails.
    """
    spark = docs.sparkSession
    columns = F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    docs = docs.select(F.monotonically_increasing_id().alias("row"), *columns, F.coalesce(learn, F.lit(False)).alias("learn"))
    docs = docs.withColumn("mark", F.xxhash64("text"))
    path = scratch_path(spark, "words")
    _word_counts(docs.select("text", "learn")).write.parquet(path)
    counted = spark.read.schema("word string, c long").parquet(path)
    ends = docs.where("learn").count()
    words, types = counted.where("c > 0").agg(F.sum("c"), F.count("*")).first()
    tokens, distinct = (words or 0) + ends, types + (ends > 0)

    pieces, weight = read_vocabulary(vocabulary)
    table, place = piece_table(pieces, weight)
    single = np.array([len(p) == 1 for p in pieces])
    for _ in range(steps if types else 0):
        used = _expectation(counted.where("c > 0"), table)[place]
        # pieces that no word used keep a little, single bytes more, so that no word is impossible
        weight = used + np.where(single, 1.0, 0.01)
        table, _ = piece_table(pieces, weight / weight.sum())
    # a text is a sequence of pieces and one end, which takes its share of the distribution
    end_share = ends / (ends + weight.sum()) if types and steps else 0.5
    table = table._replace(log_p=table.log_p + math.log1p(-end_share))

    size = float(tokens + distinct + 1)
    part, rest = word_share / max(tokens, 1), 1.0 - word_share
    cut = max(1, math.ceil(tokens / FREQUENT))
    frequent = [(r["word"].encode(), r["c"]) for r in counted.where(F.col("c") >= cut).collect()]
    spelled = marginals([MARK + w for w, _ in frequent], table) / LN10 if frequent else []
    hot = {
        w: (math.log10((c + 1) / size), math.log10(part * c + rest * 10.0**s) if word_share else s)
        for (w, c), s in zip(frequent, spelled)
    }
    end = math.log10((ends + 1) / size), math.log10(part * ends + rest * end_share)
    shipped = spark.sparkContext.broadcast(hot)
    sums = pa.schema([("row", pa.int64()), ("mark", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("left", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])
    uses = pa.schema([("row", pa.int64()), ("mark", pa.int64()), ("word", pa.string()), ("n", pa.int32())])

    def add_frequent(batches):
        hot = shipped.value
        for batch in batches:
            out = []
            for row, mark, doc_id, text in zip(*[c.to_pylist() for c in batch.columns]):
                held = words_of(text)
                found = [hot[w] for w in held if w in hot]
                base, total = math.fsum([f[0] for f in found]) + end[0], math.fsum([f[1] for f in found]) + end[1]
                out.append((row, mark, doc_id, len(held) + 1, len(found) + (ends > 0), len(held) - len(found), base, total))
            yield batch_of(sums, list(zip(*out)) or [[]] * 8)

    def rare_words(batches):
        hot = shipped.value
        for batch in batches:
            rows, marks, words, counts = [], [], [], []
            for row, mark, text in zip(*[c.to_pylist() for c in batch.columns]):
                held = Counter([w for w in words_of(text) if w not in hot])
                rows += [row] * len(held)
                marks += [mark] * len(held)
                words += held
                counts += held.values()
            yield batch_of(uses, [rows, marks, pa.array(words, pa.binary()).cast(pa.string()), counts])

    partial = docs.select("row", "mark", "doc_id", "text").mapInArrow(
        add_frequent, "row long, mark long, doc_id long, n_tokens long, n_known long, left long, base double, score double"
    )
    rare = docs.select("row", "mark", "text").mapInArrow(rare_words, "row long, mark long, word string, n int")
    scored = _word_scores(counted.where(F.col("c") < cut), table)
    one = F.col("spelled")
    if word_share:
        # an unknown word may be too unlikely for a plain number, so its logarithm is used as it is
        mixed = F.log10(F.lit(part) * F.col("c") + F.lit(rest) * F.pow(F.lit(10.0), "spelled"))
        one = F.when(F.col("c") > 0, mixed).otherwise(F.col("spelled") + F.lit(math.log10(rest)))
    scored = scored.select("word", (F.col("c") > 0).alias("known"), one.alias("score"), F.log10((F.col("c") + 1) / F.lit(size)).alias("base"))
    n = F.col("n")
    added = rare.join(scored, "word").groupBy("row", "mark").agg(
        F.sum("n").alias("more"),
        F.sum(F.when(F.col("known"), n).otherwise(0)).alias("more_known"),
        F.sum(n * F.col("base")).alias("more_base"),
        F.sum(n * F.col("score")).alias("more_score"),
    )
    found = partial.join(added, ["row", "mark"], "left")
    other_rows = F.raise_error(F.lit("two scans of the documents gave different rows; freeze the table first")).cast("long")
    whole = F.coalesce("more", F.lit(0)) == F.col("left")
    return found.select(
        "doc_id",
        F.when(whole, F.col("n_tokens")).otherwise(other_rows).alias("n_tokens"),
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
